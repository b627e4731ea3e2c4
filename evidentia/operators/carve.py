"""Carving pictures out of byte dumps. A dump is decoded as Latin-1, so that a character is a byte and an offset an offset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the file formats.
JPEG_START, JPEG_END = b"\xff\xd8", b"\xff\xd9"
PNG_START, PNG_END = b"\x89PNG\r\n\x1a\n", b"IEND\xaeB`\x82"
BMP_START = b"BM"
DIB_SIZES = (12, 40, 52, 56, 64, 108, 124)
BITS_PER_PIXEL = (1, 4, 8, 16, 24, 32)

LEAST_JPEG, LEAST_PNG, LEAST_BMP_HEADER = 128, 8, 30


def pattern(marker: bytes) -> str:
    return "".join(f"\\x{b:02x}" for b in marker)


def at(content: Column, offset: Column | int, n: int) -> Column:
    """n bytes at a 0-based offset."""
    return F.substring(content, F.lit(offset) + 1 if isinstance(offset, int) else offset + 1, F.lit(n))


def is_marker(content: Column, offset: Column, marker: bytes) -> Column:
    """Whether marker stands at offset; false outside the dump."""
    return F.coalesce((offset >= 0) & (at(content, offset, len(marker)) == F.lit(marker)), F.lit(False))


def little_endian(content: Column, offset: Column | int, n: int) -> Column:
    """Unsigned little-endian number of n bytes."""
    o = F.lit(offset) if isinstance(offset, int) else offset
    return reduce(lambda a, b: a + b, [F.conv(F.hex(at(content, o + i, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(n)])


def offsets(dumps: DataFrame, marker: bytes) -> DataFrame:
    """(dump_id, offset) of every place where marker starts, overlaps included."""
    # one character in front: a split before the very first character would give no empty piece
    pieces = F.split(F.concat(F.lit("\u0001"), F.decode("content", "ISO-8859-1")), f"(?={pattern(marker)})")
    found = dumps.select("dump_id", F.posexplode(F.transform(pieces, lambda p: F.length(p).cast("long"))).alias("n", "size"))
    w = Window.partitionBy("dump_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.sum("size").over(w) - 1).where("n > 0").select("dump_id", "offset")


def paired(dumps: DataFrame, start: bytes, stop: bytes, gap: int, form: str, least: int) -> DataFrame:
    """Every start with the first stop at gap bytes or more behind it; index counts before short ones are dropped."""
    marks = offsets(dumps, start).select("dump_id", (F.col("offset") + gap).alias("key"), F.lit(None).cast("long").alias("stop"), F.col("offset").alias("start_offset"))
    marks = marks.union(offsets(dumps, stop).select("dump_id", F.col("offset").alias("key"), (F.col("offset") + len(stop)).alias("stop"), F.lit(None).cast("long")))
    ahead = Window.partitionBy("dump_id").orderBy("key", F.col("stop").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = marks.withColumn("end_offset_exclusive", F.min("stop").over(ahead)).where("start_offset is not null and end_offset_exclusive is not null")
    found = found.withColumn("index", F.row_number().over(Window.partitionBy("dump_id").orderBy("start_offset"))).withColumn("size", F.col("end_offset_exclusive") - F.col("start_offset"))
    return found.where(F.col("size") >= least).select("dump_id", "index", "start_offset", "end_offset_exclusive", "size", F.lit(form).alias("format"))


def bmp_headers(dumps: DataFrame) -> DataFrame:
    """(dump_id, start_offset, size) of valid BMP headers; a file found is skipped before the search goes on."""
    c, o = F.col("content"), F.col("offset")
    cand = offsets(dumps, BMP_START).join(dumps.select("dump_id", "content"), "dump_id").where(F.octet_length("content") - o >= LEAST_BMP_HEADER)
    size, pixels, dib = little_endian(c, o + 2, 4), little_endian(c, o + 10, 4), little_endian(c, o + 14, 4)
    planes = F.when(dib == 12, little_endian(c, o + 22, 2)).otherwise(little_endian(c, o + 26, 2))
    depth = F.when(dib == 12, little_endian(c, o + 24, 2)).otherwise(little_endian(c, o + 28, 2))
    fits = (size >= 14 + dib) & (o + size <= F.octet_length(c)) & (pixels >= 14) & (pixels < size)
    good = cand.where((little_endian(c, o + 6, 4) == 0) & dib.isin(*DIB_SIZES) & (planes == 1) & depth.isin(*BITS_PER_PIXEL) & fits)
    lists = good.groupBy("dump_id").agg(F.array_sort(F.collect_list(F.struct(o.alias("start"), size.alias("size")))).alias("h"))
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.array().cast("array<struct<start:bigint,size:bigint>>").alias("kept"))
    step = lambda a, h: F.when(h["start"] >= a["reach"], F.struct((h["start"] + h["size"]).alias("reach"), F.concat(a["kept"], F.array(h)).alias("kept"))).otherwise(a)
    kept = lists.select("dump_id", F.posexplode(F.aggregate("h", zero, step)["kept"]).alias("n", "f"))
    return kept.select("dump_id", (F.col("n") + 1).alias("index"), F.col("f.start").alias("start_offset"), F.col("f.size").alias("size"))


def segments(dumps: DataFrame, formats: tuple[str, ...] = ("jpeg", "png", "bmp")) -> DataFrame:
    """Pictures found in dumps (dump_id, content): offsets, size, format and place. Null or empty dumps hold none."""
    dumps = dumps.where("content is not null")
    found = []
    if "jpeg" in formats:
        found.append(paired(dumps, JPEG_START, JPEG_END, 2, "jpeg", LEAST_JPEG))
    if "png" in formats:
        found.append(paired(dumps, PNG_START, PNG_END, 0, "png", LEAST_PNG))
    if "bmp" in formats:
        found.append(bmp_headers(dumps).select("dump_id", "index", "start_offset", (F.col("start_offset") + F.col("size")).alias("end_offset_exclusive"), "size", F.lit("bmp").alias("format")))
    return reduce(DataFrame.unionByName, found)


def extracted(dumps: DataFrame, found: DataFrame) -> DataFrame:
    """Segments with their bytes and digest; a dump is read once however many segments it has."""
    rows = found.join(dumps.select("dump_id", "content"), "dump_id")
    data = F.substring(F.col("content"), F.col("start_offset").cast("int") + 1, F.col("size").cast("int"))
    return rows.withColumn("data", data).withColumn("sha256", F.sha2("data", 256)).drop("content")


def upload_verdict(name: Column, content: Column) -> Column:
    """First reason to refuse an uploaded picture, or ok."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    magic = F.when(suffix == ".png", at(content, 0, 8) == F.lit(PNG_START)).otherwise(at(content, 0, 3) == F.lit(b"\xff\xd8\xff"))
    return F.when(~suffix.isin(".jpg", ".jpeg", ".png"), "bad_suffix").when(content.isNull() | (F.octet_length(content) == 0), "empty").when(F.octet_length(content) > 20 << 20, "too_large").when(~magic, "bad_magic").otherwise("ok")


class MarkerPlaces:
    """Table function (content, marker) -> offset: places where marker starts, overlaps included; none for nulls or an empty marker."""

    def eval(self, content: bytes | None, marker: bytes | None):
        at = bytes(content).find(bytes(marker)) if content and marker else -1
        while at >= 0:
            yield (at,)
            at = bytes(content).find(bytes(marker), at + 1)


def register(spark: SparkSession) -> None:
    """Make marker_places known to SQL, for LATERAL joins."""
    spark.udtf.register("marker_places", F.udtf(MarkerPlaces, returnType="offset: long", useArrow=True))


def places(dumps: DataFrame, marker: bytes) -> DataFrame:
    """(dump_id, offset) of marker in dumps (dump_id, content), by the table function."""
    register(dumps.sparkSession)
    rows = dumps.select("dump_id", "content", F.lit(marker).alias("marker"))
    return rows.sparkSession.sql("SELECT d.dump_id, o.offset FROM {dumps} d, LATERAL marker_places(d.content, d.marker) o", dumps=rows)
