"""Heartbeats of long-running strategies: event-time timers on the stream, and the same rows by sequences in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Families whose strategies take long, and seconds between two beats.
LONG_FAMILIES = ("criminisi", "patchmatch")
EVERY_S = 10
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEATS = "task long, family string, started timestamp, beat long, elapsed_s double"


class Heart(StatefulProcessor):
    """One open strategy a task. Any later event of the task closes it; those of LONG_FAMILIES open the next.

    A beat is due `every` seconds after the start and again from then on, until the strategy is closed. Due beats go out
    when the close comes, or when the watermark passes them; what was sent is kept, so none is sent twice. The state is read
    and written once a task and batch, whatever the number of events.
    """

    def __init__(self, every: int):
        self.every = every * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, family string, sent long")

    def beats(self, key: tuple, opened: list[tuple[int, str, int]], before: list[int]) -> pd.DataFrame:
        """Beats of strategies (time of start, family, beats sent), each below a time, all in microseconds."""
        started, sent = (np.array([o[k] for o in opened], np.int64) for k in (0, 2))
        n = np.maximum(-((started - np.array(before, np.int64)) // self.every) - 1 - sent, 0)
        which = np.repeat(np.arange(len(n)), n)
        beat = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + sent[which] + 1
        family = np.array([o[1] for o in opened], object)
        return pd.DataFrame({"task": np.full(len(which), key[0], np.int64), "family": family[which], "started": started[which].view("datetime64[us]"), "beat": beat, "elapsed_s": beat * self.every / 1e6})

    def keep(self, started: int, family: str, sent: int) -> None:
        self.open.update((started, family, sent))
        self.handle.registerTimer((started + (sent + 1) * self.every) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "seq"])
        at = events["ts"].astype("datetime64[us]").astype("int64").tolist()
        before = self.open.get()
        opened = ([(*before, at[0])] if before else []) + [(a, f, 0, b) for a, f, b in zip(at, events["family"], [*at[1:], None], strict=True) if f in LONG_FAMILIES]
        closed = [o for o in opened if o[3] is not None]
        if closed:
            yield self.beats(key, closed, [o[3] for o in closed])
        if before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if len(opened) > len(closed):
            self.keep(*opened[-1][:3])
        elif before:
            self.open.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.open.get()
        if before:
            found = self.beats(key, [before], [timerValues.getCurrentWatermarkInMs() * 1000 + 1])
            yield found
            self.keep(before[0], before[1], before[2] + len(found))


def beating(events: DataFrame, delay: str = "1 minute", every: int = EVERY_S) -> DataFrame:
    """The stream of beats (BEATS) of a stream of (task, ts, seq, family); family is null for events that only close.

    Events later than `delay` are left out. The state store must be RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.withWatermark("ts", delay).groupBy("task").transformWithStateInPandas(Heart(every), BEATS, "Append", "EventTime")


def beats(events: DataFrame, until: str | None = None, every: int = EVERY_S) -> DataFrame:
    """The same rows for a table of events; strategies that are still open beat up to `until` (a column name), it included."""
    w = Window.partitionBy("task").orderBy("ts", "seq")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = events.withColumn("next", F.lead("ts").over(w)).where(F.col("family").isin(*LONG_FAMILIES))
    end = F.coalesce(us("next") - 1, us(until) if until else F.lit(None).cast("long"))
    n = F.floor((end - us("ts")) / (every * 1_000_000)).cast("long")
    rows = rows.select("task", "family", F.col("ts").cast("timestamp").alias("started"), F.explode(F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n))).alias("beat"))
    return rows.select("task", "family", "started", "beat", (F.col("beat") * float(every)).alias("elapsed_s"))
