"""Matching of binary descriptors: nearest neighbours by tiles of codes, mutual matches, groups of matches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .settled import settled

#: Points of a block of a picture's, and a distance that no two codes have.
BLOCK, FAR = 1 << 15, np.uint16(65535)
#: Strong matches: pixels between the two points at least, and bits in 256 by which their descriptors differ less.
LEAST_PIXELS, MOST_BITS = 10, 50
#: Groups: pixels from the leader, matches, pixels added to the box; strong matches of full confidence and of a suspicion.
REACH, LEAST_MATCHES, MARGIN, CERTAIN, SUSPICIOUS = 40, 3, 20, 50, 10


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits by which every code of a differs from every one of b; codes are rows of longs. (Of a negative number bitwise_count counts the absolute value's bits.)"""
    return sum(np.bitwise_count((x[:, None] ^ y).view(np.uint64)).astype(np.uint16) for x, y in zip(a.T, b.T, strict=True))


def within(queries: DataFrame, points: DataFrame, words: int, most: int, bits: int | None = None) -> DataFrame:
    """(query_id, point_id, distance) of all points whose codes differ from a query's in `most` bits or fewer, itself left out.

    queries, points: point_id and code. Queries are compared with all points, block by block; only pairs that are near leave
    a task. `bits` is the number of bits in use, if the rest are 0. Null codes match nothing.
    """
    asked, rows = (df.where("code is not null").select("point_id", "code") for df in (queries, points))
    n, n_asked = rows.count(), asked.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = tiles.tables(batches)
        if tile is None or not len(tile):
            return
        one, two = tiles.sides(tile)
        (a, b), (left, right) = (tiles.matrix(x, "code", words).astype(np.int64) for x in (one, two)), (x["point_id"].to_numpy() for x in (one, two))
        for s, t in tiles.strips(len(a), len(b), False):
            distance = apart(a[s], b[t])
            q, k = np.nonzero(distance <= most)
            q, k, distance = left[s][q], right[t][k], distance[q, k].astype(np.int64)
            other = q != k
            yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (q, k, distance)], ["query_id", "point_id", "distance"])

    blocks = max(tiles.count_of(rows, n, 8 * words), -(-n_asked * 8 * words // tiles.BLOCK_BYTES))
    return tiles.crossed(asked, rows, F.col("point_id"), blocks).mapInArrow(run, "query_id long, point_id long, distance long")


def nearest(points: DataFrame, words: int, most: int | None = None) -> DataFrame:
    """(image_id, point_id, other_id, distance): the nearest other point of the picture, ties to the smallest other_id.

    points: image_id, point_id (unique in the picture), code (array of `words` longs). With `most`, neighbours beyond so many
    bits don't count and such points have no row; nor has a picture's only point, or one with a null code. A picture's points
    are dealt to blocks of about BLOCK, each two of which meet once; a point's best of a block goes on.
    """
    own = points.where("image_id is not null and code is not null").select(F.col("image_id").cast("long"), F.col("point_id").cast("long"), "code")
    sizes = own.groupBy("image_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    rows = own.join(sizes, "image_id").withColumn("block", F.pmod(F.xxhash64("point_id"), "n")).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    rows = rows.select("image_id", "point_id", "code", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("second"), (F.col("block") == F.col("other")).alias("same"))

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id").combine_chunks()
        (one, two), same = tiles.sides(table), table["same"][0].as_py()
        (a, b), ids = (tiles.matrix(x, "code", words).astype(np.int64) for x in (one, two)), [x["point_id"].to_numpy() for x in (one, two)]
        least, other = [np.full(len(x), FAR) for x in ids], [np.zeros(len(x), np.int64) for x in ids]
        for s, t in tiles.strips(len(a), len(b), False):
            distance = apart(a[s], b[t])
            if same:
                distance[ids[0][s][:, None] == ids[1][t]] = FAR
            # in order of ids, so the first of equals is the smallest
            for axis, mine, there in ((1, s, t), (0, t, s))[: 1 if same else 2]:
                side, at = 1 - axis, distance.argmin(axis=axis)
                d = np.take_along_axis(distance, np.expand_dims(at, axis), axis).ravel()
                nearer = d < least[side][mine]
                least[side][mine] = np.where(nearer, d, least[side][mine])
                other[side][mine] = np.where(nearer, ids[axis][there][at], other[side][mine])
        found = [(i, o, d) for i, o, d in zip(ids, other, least, strict=True)][: 1 if same else 2]
        i, o, d = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = d < FAR
        return pa.table({"image_id": pa.array(np.full(keep.sum(), table["image_id"][0].as_py(), np.int64)), "point_id": i[keep], "other_id": o[keep], "distance": d[keep].astype(np.int32)})

    # narrow rows, long work: so many partitions, which aren't put together
    rows = rows.repartition(tiles.WAVES * rows.sparkSession.sparkContext.defaultParallelism, "image_id", "low", "high")
    met = rows.groupBy("image_id", "low", "high").applyInArrow(best, "image_id long, point_id long, other_id long, distance int")
    found = met.groupBy("image_id", "point_id").agg(F.min(F.struct("distance", "other_id")).alias("best")).select("image_id", "point_id", "best.other_id", "best.distance")
    return found if most is None else found.where(F.col("distance") <= most)


def mutual(points: DataFrame, words: int, most: int | None = None) -> DataFrame:
    """(image_id, point_id, other_id, distance), point_id smaller: points that are each other's nearest()."""
    best = settled(nearest(points, words, most))
    back = best.select("image_id", F.col("point_id").alias("other_id"), F.col("other_id").alias("point_id"))
    return best.where("point_id < other_id").join(back, ["image_id", "point_id", "other_id"]).select("image_id", "point_id", "other_id", "distance")


def strong(matches: DataFrame, points: DataFrame, words: int) -> DataFrame:
    """Mutual matches between places LEAST_PIXELS apart whose codes differ in less than MOST_BITS of 256 bits.

    (image_id, point_id, other_id, distance, y, x, other_y, other_x, pixels); points also has y and x.
    """
    at = points.select("image_id", "point_id", "y", "x")
    other = at.select("image_id", F.col("point_id").alias("other_id"), F.col("y").alias("other_y"), F.col("x").alias("other_x"))
    rows = matches.join(at, ["image_id", "point_id"]).join(other, ["image_id", "other_id"])
    pixels = F.sqrt((F.col("y") - F.col("other_y")) ** 2 + (F.col("x") - F.col("other_x")) ** 2)
    rows = rows.withColumn("pixels", pixels).where((F.col("pixels") >= LEAST_PIXELS) & (F.col("distance") * 256 < MOST_BITS * words * 64))
    return rows.select("image_id", "point_id", "other_id", "distance", "y", "x", "other_y", "other_x", "pixels")


def beside(df: DataFrame) -> DataFrame:
    """Rows of df in each of the 25 cells (cy, cx) that a place less than two cells away may lie in."""
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i in range(-2, 3) for k in range(-2, 3)]))
    return df.withColumn("d", d).withColumns({"cy": F.col("cy") + F.col("d.i"), "cx": F.col("cx") + F.col("d.k")}).drop("d")


def leaders(places: DataFrame, reach: int = REACH) -> DataFrame:
    """(image_id, place, leader): each place's leader, as if places were gone through in order.

    places: image_id, place (their order), y, x. A place that no earlier leader is less than `reach` pixels away from leads
    itself; any other follows the first such leader. Places lie in grid cells of half that size, and of those at one spot
    only the first is looked at. In every round, open places that are the first ones of all cells in reach lead, and open
    ones that they reach are led. No two places are paired but those with leaders, of which few can be in reach, so a round
    is linear in the open places; rounds are as many as the longest chain of leaders that depend on each other.
    """
    cell = lambda c: F.floor(2 * F.col(c) / reach).cast("long")
    rows = settled(places.select("image_id", "place", "y", "x", cell("y").alias("cy"), cell("x").alias("cx")))
    at, near = ["image_id", "cy", "cx"], (F.col("y") - F.col("ly")) ** 2 + (F.col("x") - F.col("lx")) ** 2 < reach**2
    left = settled(rows.where("image_id is not null and y is not null and x is not null").groupBy(*at, "y", "x").agg(F.min("place").alias("place")))
    found = []
    while not left.isEmpty():
        first = left.groupBy(*at).agg(F.min(F.struct("place", "y", "x")).alias("first"))
        least = beside(first.select(*at, "first.place")).groupBy(*at).agg(F.min("place").alias("least"))
        lead = settled(first.join(least, at).where("first.place = least").select(*at, F.col("first.place").alias("leader"), F.col("first.y").alias("ly"), F.col("first.x").alias("lx")))
        found.append(lead)
        left = settled(left.alias("left").join(beside(lead).alias("lead"), [F.col(f"left.{c}") == F.col(f"lead.{c}") for c in at] + [near], "left_anti"))
    if not found:
        return rows.select("image_id", "place", F.col("place").alias("leader"))
    found = reduce(DataFrame.unionByName, found)
    led = rows.join(beside(found), at).where(near).groupBy("image_id", "place").agg(F.min("leader").alias("leader"))
    # one without a spot has none beside it
    return rows.join(led, ["image_id", "place"], "left").select("image_id", "place", F.coalesce("leader", "place").alias("leader"))


def numbered(matches: DataFrame) -> DataFrame:
    """matches with their number in the picture in order of point_id as `place`; ranges are numbered, so no picture goes through one task."""
    rows = settled(matches.repartitionByRange("image_id", "point_id").withColumn("part", F.spark_partition_id()))
    n = rows.groupBy("image_id", "part").agg(F.count("*").alias("n"))
    before = n.select("image_id", "part", F.sum("n").over(Window.partitionBy("image_id").orderBy("part")).alias("upto"), "n")
    place = F.row_number().over(Window.partitionBy("image_id", "part").orderBy("point_id")) + F.col("upto") - F.col("n")
    return rows.join(before, ["image_id", "part"]).withColumn("place", place).drop("part", "upto", "n")


def groups(matches: DataFrame) -> DataFrame:
    """(image_id, leader, x, y, w, h, n_matches): boxes of the matches of a picture around their leaders.

    matches: image_id, point_id (their order), y, x. Groups of fewer than LEAST_MATCHES are left out.
    """
    rows = settled(numbered(matches.select("image_id", "point_id", "y", "x")))
    rows = rows.join(leaders(rows), ["image_id", "place"]).groupBy("image_id", "leader").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + MARGIN).alias("w"), (F.max("y") - F.min("y") + MARGIN).alias("h"), F.count("*").alias("n_matches"))
    return rows.where(F.col("n_matches") >= LEAST_MATCHES)


def verdicts(points: DataFrame, matches: DataFrame) -> DataFrame:
    """(image_id, n_keypoints, strong_matches, suspicious, confidence) of every picture with points, from its strong matches."""
    n = matches.groupBy("image_id").agg(F.count("*").alias("n"))
    rows = points.groupBy("image_id").agg(F.count("*").alias("n_keypoints")).join(n, "image_id", "left").withColumn("strong_matches", F.coalesce("n", F.lit(0)))
    suspicious = F.col("strong_matches") >= SUSPICIOUS
    return rows.select("image_id", "n_keypoints", "strong_matches", suspicious.alias("suspicious"), F.when(suspicious, F.least(F.lit(1.0), F.bround(F.col("strong_matches") / CERTAIN, 3))).otherwise(0.0).alias("confidence"))
