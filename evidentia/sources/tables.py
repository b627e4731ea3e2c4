"""Readers: driver tables, byte dumps, images, logs, result files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dumps(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row a file: dump_id (path), length, content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("dump_id"), "length", "content")


def fragment_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a directory as fragments in order of name: dump_id (the directory), idx from 1, off (idx - 1), path, size, sha256, data.

    Files are numbered directory by directory, on their names alone; contents are joined to the numbers. Spark's reader leaves
    empty files out.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    order = found.select("path", folder.alias("dump_id")).withColumn("idx", F.row_number().over(Window.partitionBy("dump_id").orderBy("path")).cast("long"))
    return order.join(found.select("path", "length", "content"), "path").select("dump_id", "idx", (F.col("idx") - 1).alias("off"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("content").alias("data"))


def marker_offsets(spark: SparkSession, path: str, marker: bytes, glob: str = "*", size: int = 64 << 20) -> DataFrame:
    """(dump_id, offset) of every place where marker starts, overlaps included, in files of any length.

    A task reads a range of `size` bytes and as many behind it as a marker across its end needs; a marker belongs to the
    range that it starts in. Files are opened by `pyarrow.fs`. Empty files hold none.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where("length > 0")
    ranges = found.select(F.col("path").alias("dump_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    look = re.compile(b"(?=" + re.escape(marker) + b")")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dump, start in batch.itertuples(index=False):
                files, name = FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", dump), safe="/:@"))
                with files.open_input_file(name) as f:
                    data = f.read_at(min(size + len(marker) - 1, f.size() - start), start)
                at = [start + m.start() for m in look.finditer(data) if m.start() < size]
                yield pd.DataFrame({"dump_id": dump, "offset": pd.Series(at, dtype="int64")})

    return ranges.repartition("dump_id", "start").mapInPandas(scan, "dump_id string, offset long")


def file_listing(spark: SparkSession, path: str, glob: str = "*", newest: int = 10) -> DataFrame:
    """Newest files first; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path").limit(newest)


def images(spark: SparkSession, path: str) -> DataFrame:
    """JPEG, PNG and BMP files decoded by the JVM: image_id, height, width, n_channels, data (rows of BGR bytes)."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    return found.select(F.col("image.origin").alias("image_id"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def audit_log(spark: SparkSession, path: str, last: int = 100) -> DataFrame:
    """Last rows of a JSONL audit log, newest first; bad lines are skipped."""
    return spark.read.option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("timestamp")).limit(last)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def raster(embeddings: DataFrame) -> DataFrame:
    """vec_id, y, x, v: each vector as an 8 x 8 picture of whole values from 0 to 255."""
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    p = embeddings.select("vec_id", low.alias("lo"), high.alias("hi"), F.posexplode("embedding").alias("p", "e"))
    v = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("e").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0)
    return p.select("vec_id", F.floor(F.col("p") / 8).cast("long").alias("y"), (F.col("p") % 8).cast("long").alias("x"), v.cast("long").alias("v"))
