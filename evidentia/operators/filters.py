"""Filters and simulated damage on relations of pixels (keys, y, x, v), at any size; chance comes from the pixels' keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid

# Fixed values of the filters: binomial weights, window and reach, deviations.
BINOMIAL = (1, 4, 6, 4, 1)
MEDIAN, BOX, BILATERAL, RANGE_SIGMA, SPACE_SIGMA, COLUMN = 5, 8, 7, 50.0, 50.0, 5
HALO, PEPPER = 10, 0.05
#: Modulus of the pseudo-random numbers, a prime, and the factors of picture, row, column and seed.
MODULUS, FACTORS = 1_000_003, (7919, 104_729, 611_953, 15_485_863)


def weighted(column: str, w: Window, weights: tuple[float, ...]) -> Column:
    """Weighted sum of a pixel and those around it along w; null where one is missing."""
    reach = len(weights) // 2
    at = lambda d: F.lag(column, -d).over(w) if d < 0 else F.lead(column, d).over(w) if d else F.col(column)
    return sum((F.lit(k) * at(i - reach) for i, k in enumerate(weights[1:], 1)), F.lit(weights[0]) * at(-reach))


def inner(padded: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """What lies inside the pictures of the mirrored pixels."""
    return padded.join(grid.sizes(pixels, keys), keys).where("y >= 0 and y < height and x >= 0 and x < width").drop("height", "width")


def gaussian(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v smoothed by 5 x 5 binomial weights, mirrored at the edges, rounded half up."""
    rows = grid.padded(pixels.select(*keys, "y", "x", F.col("v").cast("long").alias("v")), keys, 2)
    rows = rows.withColumn("v", weighted("v", grid.along(keys, "x"), BINOMIAL)).withColumn("v", weighted("v", grid.along(keys, "y"), BINOMIAL))
    return inner(rows, pixels, keys).select(*keys, "y", "x", F.floor((F.col("v") + 128) / 256).cast("long").alias("v"))


def column_smooth(pixels: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """keys, y, x, v smoothed down the columns by a Gaussian of deviation 1, so many times; rounded half to even each time."""
    g = [math.exp(-((i - COLUMN // 2) ** 2) / 2) for i in range(COLUMN)]
    weights = tuple(x / sum(g) for x in g)
    for _ in range(times):
        rows = grid.padded(pixels.select(*keys, "y", "x", F.col("v").cast("double").alias("v")), keys, 2)
        rows = rows.withColumn("v", weighted("v", grid.along(keys, "y"), weights))
        pixels = inner(rows, pixels, keys).select(*keys, "y", "x", F.rint("v").cast("long").alias("v"))
    return pixels


def box(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v: means of 8 x 8 windows, four pixels before and three behind, mirrored at the edges, half to even."""
    rows = grid.padded(pixels.select(*keys, "y", "x", F.col("v").cast("long").alias("v")), keys, BOX // 2)
    for axis in ("x", "y"):
        rows = rows.withColumn("v", F.sum("v").over(grid.along(keys, axis).rowsBetween(-(BOX // 2), BOX - BOX // 2 - 1)))
    return inner(rows, pixels, keys).select(*keys, "y", "x", F.rint(F.col("v") / (BOX * BOX)).cast("long").alias("v"))


def around(pixels: DataFrame, keys: list[str], reach: int, mirrored: bool) -> DataFrame:
    """keys, y, x, v, near: the values of the window around each pixel, row by row; beyond the edge mirrored, or the edge's own."""
    own = pixels.select(*keys, "y", "x", F.col("v").cast("long").alias("v"))
    if mirrored:
        rows = grid.padded(own, keys, reach)
    else:
        edge = lambda c, n: F.explode(F.sequence(c - F.when(c == 0, reach).otherwise(0), c + F.when(c == n - 1, reach).otherwise(0)))
        rows = own.join(grid.sizes(pixels, keys), keys)
        rows = rows.withColumn("y", edge(F.col("y").cast("long"), F.col("height"))).withColumn("x", edge(F.col("x").cast("long"), F.col("width"))).drop("height", "width")
    rows = rows.withColumn("line", F.collect_list("v").over(grid.along(keys, "x").rowsBetween(-reach, reach)))
    rows = rows.withColumn("near", F.flatten(F.collect_list("line").over(grid.along(keys, "y").rowsBetween(-reach, reach)))).drop("line")
    return inner(rows, pixels, keys)


def median(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v: medians of 5 x 5, the edge's pixels repeated beyond it."""
    return around(pixels, keys, MEDIAN // 2, False).select(*keys, "y", "x", F.sort_array("near")[MEDIAN * MEDIAN // 2].alias("v"))


def bilateral(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v: means over a circle, weighed by nearness in place and in value; mirrored at the edges, half to even."""
    reach = BILATERAL // 2
    far = [(i // BILATERAL - reach) ** 2 + (i % BILATERAL - reach) ** 2 for i in range(BILATERAL * BILATERAL)]
    space = F.array(*[F.lit(math.exp(-d / (2 * SPACE_SIGMA**2)) if d <= reach**2 else 0.0) for d in far])
    rows = around(pixels, keys, reach, True)
    weight = F.zip_with("near", space, lambda x, s: s * F.exp(-((x - F.col("v")) * (x - F.col("v"))).cast("double") / (2 * RANGE_SIGMA**2)))
    total = F.aggregate(F.zip_with("near", "w", lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) / F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("w", weight).select(*keys, "y", "x", F.rint(total).cast("long").alias("v"))


# ---- damage ----


def chance(picture: Column, seed: int, y: Column | None = None, x: Column | None = None) -> Column:
    """A number from 0 to below 1 that a pixel (picture, y, x) has under a seed."""
    a, b, c, d = FACTORS
    mixed = picture * a + (F.col("y") if y is None else y) * b + (F.col("x") if x is None else x) * c + seed * d
    twice = (mixed % MODULUS) * (mixed % MODULUS + seed) % MODULUS
    return ((twice * 48_271 + mixed) % MODULUS).cast("double") / MODULUS


def bell(picture: Column, seed: int) -> Column:
    """A normal number of a pixel, from two even ones."""
    return F.sqrt(-2 * F.log(1 - chance(picture, seed))) * F.cos(2 * math.pi * chance(picture, seed + 1))


def loud(v: Column, picture: Column, sigma: float, seed: int) -> Column:
    """The value with noise, kept from 0 to 255, then cut to a whole number."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v + sigma * bell(picture, seed)))).cast("long")


def noise(pixels: DataFrame, picture: str, zone: Column, sigma: float = 25.0, seed: int = 0) -> DataFrame:
    """pixels with v noisy and hit true inside the zone."""
    return pixels.withColumn("hit", zone).withColumn("v", F.when(F.col("hit"), loud(F.col("v"), F.col(picture), sigma, seed)).otherwise(F.col("v")))


def salt_and_pepper(pixels: DataFrame, picture: str, zone: Column, seed: int = 0) -> DataFrame:
    """pixels with a twentieth of the zone black, another white; the whole zone is marked."""
    dice = chance(F.col(picture), seed)
    return pixels.withColumn("hit", zone).withColumn("v", F.when(F.col("hit") & (dice < PEPPER), 0).when(F.col("hit") & (dice > 1 - PEPPER), 255).otherwise(F.col("v")))


def combined(pixels: DataFrame, picture: str, y0: Column, y1: Column, x0: Column, x1: Column, fill: int = 0, sigma: float = 12.0, seed: int = 0) -> DataFrame:
    """pixels with a filled rectangle and noise HALO pixels around it, which isn't marked. y1 and x1 are behind the last."""
    inside = lambda m: (F.col("y") >= y0 - m) & (F.col("y") < y1 + m) & (F.col("x") >= x0 - m) & (F.col("x") < x1 + m)
    rows = pixels.withColumn("hit", inside(0))
    return rows.withColumn("v", F.when(F.col("hit"), fill).when(inside(HALO), loud(F.col("v"), F.col(picture), sigma, seed)).otherwise(F.col("v")))


def bars(pixels: DataFrame, picture: str, count: int = 4, thickness: int = 10, vertical: bool = False, fill: int = 0, seed: int = 0) -> DataFrame:
    """pixels with so many bars across each picture, at places that follow from the picture and the seed; bars may overlap."""
    axis, size = ("x", "width") if vertical else ("y", "height")
    spots = grid.sizes(pixels, [picture]).select(picture, F.greatest(F.lit(1), F.col(size) - thickness).alias("limit"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("x")).withColumn("y", F.lit(0).cast("long"))
    spots = spots.select(picture, F.floor(chance(F.col(picture), seed) * F.col("limit")).cast("long").alias("at"))
    lines = spots.select(picture, F.explode(F.sequence("at", F.col("at") + thickness - 1)).alias(axis)).distinct().withColumn("hit", F.lit(True))
    rows = pixels.join(lines, [picture, axis], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return rows.withColumn("v", F.when(F.col("hit"), fill).otherwise(F.col("v")))


def imperfect(mask: DataFrame, picture: str, grow: int = 1, shrink: int = 0, share: float = 0.01, seed: int = 0) -> DataFrame:
    """mask (picture, y, x, hit 0 or 1) grown and shrunk by 5 x 5, then that share of the pixels set and another cleared."""
    rows = grid.spread(mask, [picture], "hit", 2 * grow, True) if grow else mask
    rows = grid.spread(rows, [picture], "hit", 2 * shrink, False) if shrink else rows
    dice = chance(F.col(picture), seed)
    return rows.withColumn("hit", F.when(dice < share, 1).when(dice > 1 - share, 0).otherwise(F.col("hit")))
