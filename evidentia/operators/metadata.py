"""EXIF of JPEG files: the TIFF directories as a map, and rules that mark suspicious ones."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag numbers and names of the standard, directories that a tag points to, and editing programs.
TAGS = {
    0x0102: "bits_per_sample", 0x0103: "compression", 0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x011A: "resolution_x", 0x011B: "resolution_y", 0x0131: "software", 0x0132: "modified",
    0x829A: "exposure", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken", 0x9004: "digitized", 0x9209: "flash", 0x920A: "focal_length", 0xA001: "color_space", 0xA002: "width", 0xA003: "height",
}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
EDITORS = (
    "photoshop", "gimp", "lightroom", "affinity", "pixelmator", "capture one", "darktable", "rawtherapee", "luminar", "dall-e", "stable diffusion",
    "midjourney", "firefly", "topaz", "imagemagick", "paint.net",
)
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif_tags(data: bytes) -> dict[str, str]:
    """Known tags of the first directory, the EXIF and the GPS directory; broken ones end the walk.

    gps is there, as 1, where a GPS directory is, whatever it holds.
    """
    at = data.find(b"Exif\x00\x00")
    if data[:2] != b"\xff\xd8" or at < 0:
        return {}
    tiff = data[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    out: dict[str, str] = {}
    if not order:
        return out

    def value(kind: int, n: int, raw: bytes) -> str:
        if kind == 2:
            return raw[:n].split(b"\x00")[0].decode("latin-1")
        if kind in (5, 10):
            v = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw[: 8 * n])
            return ",".join(str(a / b) if b else "0" for a, b in zip(v[::2], v[1::2], strict=True))
        return ",".join(map(str, struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * n, raw[: SIZES[kind] * n])))

    if len(tiff) < 8:
        return out
    todo, seen = [(struct.unpack(order + "I", tiff[4:8])[0], TAGS)], set()
    while todo:
        place, names = todo.pop()
        if place in seen:
            continue
        seen.add(place)
        try:
            (count,) = struct.unpack(order + "H", tiff[place : place + 2])
            for i in range(count):
                tag, kind, n = struct.unpack(order + "HHI", tiff[place + 2 + 12 * i : place + 10 + 12 * i])
                size = SIZES.get(kind, 0) * n
                field = tiff[place + 10 + 12 * i : place + 14 + 12 * i]
                if tag in (EXIF_POINTER, GPS_POINTER):
                    todo.append((struct.unpack(order + "I", field)[0], TAGS if tag == EXIF_POINTER else GPS_TAGS))
                    out |= {"gps": "1"} if tag == GPS_POINTER else {}
                elif tag in names and size:
                    start = struct.unpack(order + "I", field)[0]
                    out[names[tag]] = value(kind, n, tiff[start : start + size] if size > 4 else field)
        except struct.error:
            break
    return out


def exif(files: DataFrame) -> DataFrame:
    """(dump_id, content) -> dump_id, tags map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"dump_id": b["dump_id"], "tags": [exif_tags(bytes(x or b"")) for x in b["content"]]})

    return files.select("dump_id", "content").mapInPandas(run, "dump_id string, tags map<string,string>")


def degrees(dms, ref):
    """Degrees, minutes, seconds as text -> signed degrees; 0 has a sign, too."""
    p = F.transform(F.split(dms, ","), lambda x: x.try_cast("double"))
    return F.when(F.upper(ref).isin("S", "W"), -1.0).otherwise(1.0) * F.round(F.get(p, F.lit(0)) + F.get(p, F.lit(1)) / 60 + F.get(p, F.lit(2)) / 3600, 6)


def record(tagged: DataFrame) -> DataFrame:
    """(dump_id, tags) -> dump_id, the nineteen columns of an EXIF record, raw_tags. What is absent or no number is null.

    A position needs degrees, minutes and seconds and the side of the equator or of Greenwich.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    number = lambda k, kind="long": F.get(F.split(tag(k), ","), F.lit(0)).try_cast(kind)
    place = lambda k: F.when(tag(f"{k}_ref").isNotNull() & (F.size(F.split(tag(k), ",")) == 3), degrees(tag(k), tag(f"{k}_ref")))
    return tagged.select(
        "dump_id", (F.size("tags") > 0).alias("exif_present"), tag("make").alias("camera_make"), tag("model").alias("camera_model"), tag("software").alias("software"), tag("taken").alias("datetime_original"), tag("modified").alias("datetime_modified"),
        tag("gps").isNotNull().alias("gps_present"), place("lat").alias("gps_lat"), place("lon").alias("gps_lon"), number("orientation").alias("orientation"), number("resolution_x", "double").alias("resolution_x"), number("resolution_y", "double").alias("resolution_y"),
        number("iso").alias("iso"), number("exposure", "double").alias("exposure"), number("focal_length", "double").alias("focal_length"), number("flash").alias("flash"), number("color_space").alias("color_space"), number("compression").alias("compression"),
        tag("bits_per_sample").alias("bits_per_sample"), F.col("tags").alias("raw_tags"),
    )


def edited(software: Column) -> Column:
    """Whether one of the EDITORS is named in it."""
    return F.exists(F.array(*[F.lit(e) for e in EDITORS]), lambda e: F.contains(F.lower(F.coalesce(software, F.lit(""))), e))


def plainly(number: Column) -> Column:
    """A number of at most six decimals as text, small ones without an exponent."""
    text = F.rtrim(number.cast("decimal(38,6)").cast("string"), F.lit("0"))
    return F.when((number != 0) & (F.abs(number) < 1e-3), text).otherwise(number.cast("string"))


def consistency(records: DataFrame) -> DataFrame:
    """record() with flags, suspicion_score (0.2 a flag, 1 at most) and suspicious. Empty texts count as absent."""
    there = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    place = F.when(F.col("gps_lat").isNotNull(), F.concat(F.lit(" ("), plainly(F.col("gps_lat")), F.lit(", "), F.coalesce(plainly(F.col("gps_lon")), F.lit("?")), F.lit(")"))).otherwise("")
    flags = F.array_compact(
        F.array(
            F.when(~F.col("exif_present"), "no EXIF"),
            F.when(edited(F.col("software")), F.concat(F.lit("edited with "), "software")),
            F.when(there("datetime_original") & there("datetime_modified") & (F.col("datetime_original") != F.col("datetime_modified")), F.concat(F.lit("taken "), "datetime_original", F.lit(", modified "), "datetime_modified")),
            F.when(F.col("gps_present"), F.concat(F.lit("position"), place)),
            F.when((F.col("orientation") != 0) & ~F.col("orientation").between(1, 8), F.concat(F.lit("orientation "), "orientation")),
            F.when(F.col("exif_present") & ~there("camera_model"), "no camera model"),
        )
    )
    rows = records.withColumn("flags", flags)
    return rows.withColumn("suspicion_score", F.round(F.least(F.lit(1.0), 0.2 * F.size("flags")), 2)).withColumn("suspicious", F.size("flags") > 0)
