"""The corpus pipeline: documents through quality rules, near-duplicates, repeated passages, leaked items and the mix.

Every stage takes all that its predecessor kept, of any columns beside doc_id, text and source, and returns those columns;
the mix adds its own. Empty tables give empty ones. Equal rows are treated alike, except that near-dedup keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, mixing, passages, rules, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the learned decision list keep.

    Null and empty texts have under ten words and go; without labels only the base limits count. doc_id, null or
    repeated, plays no part: each row is judged by its whole text.
    """
    return rules.passing(docs, common.table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of equal or near-equal ones (five-word shingles, similarity 0.8).

    Rows with a null doc_id or text all stay. Of rows equal in doc_id and text one stays; different texts under one
    doc_id are separate documents.
    """
    return simhash.without_copies(docs, common.settle(simhash.near_copies(docs), "copies"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of fifty words or more that nearly repeat one of an earlier document.

    A document with no word left goes. Rows without a doc_id come last, so they lose what they share with others. Null
    texts stay as they are, as do those without a repeat.
    """
    return passages.without(docs, common.settle(passages.repeated_passages(docs), "passages"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts stay; without items all do."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, all their columns as they are, with the copies to take of each.

    Null and wordless texts have no size and are never taken; a null source is a source.
    """
    copies = common.fresh_names(docs, *mixing.MADE)[mixing.MADE.index("copies")]
    return mixing.mix(docs, carry=True).where(F.col(copies) > 0)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]

#: Learned rules, fingerprints and edit distances have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read back."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """run() to a Parquet table at path; then the tables between the stages are deleted."""
    run(spark, sf_dir).write.parquet(path)
    common.clear(spark)
