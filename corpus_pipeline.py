"""The corpus pipeline: its stages, its order and its run are in evidentia.llm.pipeline."""

from evidentia.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
