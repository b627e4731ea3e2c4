"""Carving dumps of any length: marks are found, paired and cut by byte ranges, and only summaries of ranges meet."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import carve
from .settled import settled

#: Bytes of a range.
RANGE = 64 << 20


def open_dump(path: str):
    """The dump as a random-access file; Spark's paths are taken as they are, blanks and all."""
    files, name = FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe="/:@"))
    return files.open_input_file(name)


def places(data: bytes, marker: bytes, end: int) -> Iterator[int]:
    """Offsets below end at which marker starts, overlaps included."""
    at = data.find(marker)
    while 0 <= at < end:
        yield at
        at = data.find(marker, at + 1)


def marks(spark: SparkSession, path: str, markers: dict[str, bytes], glob: str = "*", size: int = RANGE) -> DataFrame:
    """(dump_id, kind, offset) of all markers in files of any length, from one read of each range.

    A task reads its range and as many bytes behind it as the longest marker across its end needs; a mark belongs to the
    range that it starts in. Empty files have none. The files' contents never enter a row.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where("length > 0")
    ranges = found.select(F.col("path").alias("dump_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    behind = max(map(len, markers.values())) - 1

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dump, start in batch.itertuples(index=False):
                with open_dump(dump) as f:
                    data = f.read_at(min(size + behind, f.size() - start), start)
                for kind, marker in markers.items():
                    yield pd.DataFrame({"dump_id": dump, "kind": kind, "offset": pd.Series([start + at for at in places(data, marker, size)], dtype="int64")})

    return ranges.repartition("dump_id", "start").mapInPandas(scan, "dump_id string, kind string, offset long")


def paired(starts: DataFrame, stops: DataFrame, gap: int, tail: int, size: int = RANGE) -> DataFrame:
    """(dump_id, index, start_offset, end_offset_exclusive, size): every start with the first stop gap bytes or more behind it.

    starts, stops: dump_id and offset. tail is the stop's length. index counts a dump's pairs from 1 in order of starts.
    Starts are keyed by the first place at which a stop counts, and starts and stops meet within ranges of `size` keys. A
    start left open there takes the first stop of the next range that has one: that is looked up in a summary with a row a
    range, as is the number of pairs before a range. So no window holds more than a range's marks or a dump's summaries.
    Marks that repeat count once; null offsets or dump_ids are left out.
    """
    at = F.col("offset").cast("long")
    own = starts.select("dump_id", (at + gap).alias("key"), at.alias("start"), F.lit(None).cast("long").alias("stop"))
    rows = own.unionByName(stops.select("dump_id", at.alias("key"), F.lit(None).cast("long").alias("start"), at.alias("stop"))).where("dump_id is not null and key is not null").distinct()
    rows = rows.withColumn("range", F.floor(F.col("key") / size).cast("long"))
    ahead = Window.partitionBy("dump_id", "range").orderBy("key", F.col("stop").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = settled(rows.withColumn("near", F.min("stop").over(ahead)))
    later = Window.partitionBy("dump_id").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    summary = rows.groupBy("dump_id", "range").agg(F.min("stop").alias("first"), F.count("near").alias("closed"), F.count("start").alias("starts"), F.count(F.when(F.col("start").isNotNull(), F.col("near"))).alias("paired"))
    summary = summary.withColumn("next", F.min("first").over(later))
    before = Window.partitionBy("dump_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("next").isNull(), F.col("paired")).otherwise(F.col("starts"))
    summary = settled(summary.withColumn("before", F.coalesce(F.sum(counted).over(before), F.lit(0))).select("dump_id", "range", "next", "before"))
    found = rows.where("start is not null").join(summary, ["dump_id", "range"]).withColumn("stop", F.coalesce("near", "next")).where("stop is not null")
    place = F.row_number().over(Window.partitionBy("dump_id", "range").orderBy("start"))
    stop = F.col("stop") + tail
    return found.select("dump_id", (F.col("before") + place).alias("index"), F.col("start").alias("start_offset"), stop.alias("end_offset_exclusive"), (stop - F.col("start")).alias("size"))


def segments(spark: SparkSession, path: str, glob: str = "*", size: int = RANGE) -> DataFrame:
    """JPEG and PNG pictures in dumps of any length, as carve.segments finds them in dumps that fit a row."""
    markers = {"jpeg_start": carve.JPEG_START, "jpeg_stop": carve.JPEG_END, "png_start": carve.PNG_START, "png_stop": carve.PNG_END}
    found = settled(marks(spark, path, markers, glob, size))
    forms = [("jpeg", 2, len(carve.JPEG_END), carve.LEAST_JPEG), ("png", 0, len(carve.PNG_END), carve.LEAST_PNG)]
    kind = lambda name: found.where(F.col("kind") == name).select("dump_id", "offset")
    pairs = [paired(kind(f"{form}_start"), kind(f"{form}_stop"), gap, tail, size).where(F.col("size") >= least).withColumn("format", F.lit(form)) for form, gap, tail, least in forms]
    return reduce(DataFrame.unionByName, pairs)


def extracted(found: DataFrame, size: int = RANGE) -> DataFrame:
    """found (dump_id, start_offset, size and others) with data and sha256, read from the dumps segment by segment.

    Segments of one range of a dump are read by one task; a segment over 2 GB has no data. Dumps that are gone are an error.
    """
    columns = found.columns

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 16):
                rows = batch.iloc[i : i + 16].copy()
                data = []
                for dump, start, n in rows[["dump_id", "start_offset", "size"]].itertuples(index=False):
                    with open_dump(dump) as f:
                        data.append(f.read_at(int(n), int(start)) if n < 1 << 31 else None)
                rows["data"] = data
                yield rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", data binary"
    dealt = found.repartition("dump_id", F.floor(F.col("start_offset") / size))
    return dealt.mapInPandas(cut, schema).select(*columns, "data", F.sha2("data", 256).alias("sha256"))
