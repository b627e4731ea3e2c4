"""Progress events as streams: running counts, throttled log, windowed totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.settled import shared_folder
from . import store

GAP_S = 30
FORCED = ("error", "purchase")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("completed"), F.max("value").alias("best"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling hours; late events count for a day."""
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour_start"), "event_type", "n")


def throttle_rows(times: list[float], kinds: list[str], last: float | None) -> tuple[list[bool], float | None]:
    """Which events are logged: forced kinds, and any other GAP_S seconds or more after the last one logged."""
    out = []
    for t, kind in zip(times, kinds, strict=True):
        log = last is None or kind in FORCED or t - last >= GAP_S
        last = t if log else last
        out.append(log)
    return out, last


def throttled(events: DataFrame) -> DataFrame:
    """The events that a throttled log keeps, per user; the time of the last one is the state."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        keep, last = throttle_rows((rows["ts"].astype("int64") / 1e9).tolist() if rows["ts"].dtype == "datetime64[ns]" else [t.timestamp() for t in rows["ts"]], rows["event_type"].tolist(), last)
        state.update((last,))
        yield rows.loc[keep, ["user_id", "event_id", "event_type"]]

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, event_type string", "last double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, keys: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Run the stream over what is there, into files under a checkpoint, and return them as a table.

    Appended rows go to a Parquet sink; a complete result and updates (of rows told apart by keys) to versions in a store
    that a replayed batch doesn't change. A folder that was drained before goes on from where it stopped.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{folder}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    merge = store.replaced(list(keys)) if mode == "update" else lambda _, batch: batch
    writer.foreachBatch(store.upserts(f"{folder}/rows", stream.schema, merge)).start().awaitTermination()
    return store.read(spark, f"{folder}/rows", stream.schema)
