"""Shared plumbing: shared-folder tables, null-safe document columns, Arrow text buffers, components of link graphs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: For bytes.translate: A-Z to a-z, all else as it is.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Text bytes that a kernel turns into NumPy arrays at a time.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session that names none gets one; on a cluster its absence is an error."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
    return sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def settled_dir(spark: SparkSession) -> str:
    """This application's folder for tables and archives between steps; it goes with the application, or by clear()."""
    folder = f"{shared_dir(spark).rstrip('/')}/settled/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def settle(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs nothing already done."""
    spark = df.sparkSession
    path = f"{settled_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's settled tables and archives; results that still read them must have been written before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(settled_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that body reads it any number of times and it is computed once a row."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def add(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about limit bytes of text each (one row at least), with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, ends = text_arrays(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
            start = stop


def linked(edges: DataFrame) -> DataFrame:
    """Components of a link graph: (node, root), root the smallest node reachable; nodes without links don't appear.

    Alternates large-star and small-star rounds; each round is written to the shared folder. Stars' neighbours are
    never gathered: a minimum per node (combined before the shuffle) is joined back.
    edges: columns a, b of one orderable type. Empty input gives an empty result.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = settle(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


LONG, TEXT = T.LongType(), T.StringType()
