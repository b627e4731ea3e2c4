"""Cutting lineage through the shared checkpoint folder, dealing rows out, and components of link graphs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context was given.

    A local session without one gets a temporary one, a cluster without one is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, which outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """df dealt out by keys into parts of about `most` rows, as many as the rows need and no fewer than the session's.

    What is sorted in a task is bounded by `most` then, whatever the table's size, and windows and groups over the keys, and over
    rows made of these ones, need no further shuffle. The rows are counted first.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // most))
    return df.repartition(parts, *keys)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes in links (a, b): root is the smallest node that can be reached.

    Every round hangs each node's larger neighbours, then its smaller ones, on the smallest node beside it, until nothing
    moves; a round needs two joins with one minimum a node, and no node's neighbours are gathered.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = ways.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        up = ways.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = up.groupBy("a").agg(F.min("b").alias("low"))
        down = up.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        edges = settled(down.select("e.*").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
