"""Pictures as relations of pixels (keys, y, x, v): window sums, stencils, morphology and components at any size.

Nothing here gathers a picture: windows run along single rows and columns, sizes and thresholds are joined back, and connected
parts are found on runs of pixels. Pictures are whole rectangles from (0, 0); keys are the columns that tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settled import components, dealt, settled

#: Pixels that a task has at once where pictures are dealt out whole.
PART = 1 << 18
#: Columns of a cell in which runs of neighbouring rows meet.
CELL = 32
# Fixed values of the detectors.
VARIANCE_WINDOW, LOW_VARIANCE, WEAK_GRADIENT, DARK = 11, 6.0, 4.0, 22
LEAST_AREA, LEAST_SHARE, MOST_SHARE = 200, 0.0005, 0.60
SMALL_PICTURE = 2500


def along(keys: list[str], axis: str) -> Window:
    """Pixels in order of axis, within the row (axis x) or column (axis y) that they are in."""
    return Window.partitionBy(*keys, "y" if axis == "x" else "x").orderBy(axis)


def sizes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, width."""
    return pixels.groupBy(*keys).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def box_sums(pixels: DataFrame, keys: list[str], reach: int, **sums: Column) -> DataFrame:
    """pixels with the sums of the given columns over windows of 2 * reach + 1 squared, cut at the picture's edges.

    Running sums along rows, then columns: a window's sum is a difference of two, so its size costs nothing. Of whole
    numbers the sums are exact.
    """
    out = pixels.withColumns(sums)
    for axis in ("x", "y"):
        w = along(keys, axis)
        out = out.withColumns({n: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n in sums})
        last = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumns({n: F.coalesce(F.lead(n, reach).over(w), F.last(n).over(last)) - F.coalesce(F.lag(n, reach + 1).over(w), F.lit(0)) for n in sums})
    return out


def padded(pixels: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """pixels and, around them, `reach` further ones mirrored at the edge pixels (which aren't repeated); columns as they are.

    The mirrored ones have coordinates below 0 or beyond the size. A picture one pixel wide repeats that pixel.
    """

    def images(at: Column, n: Column) -> Column:
        period = 2 * (n - 1)
        turns = F.sequence(-F.ceil(reach / period) - 1, F.ceil(reach / period) + 1)
        all_ = F.flatten(F.transform(turns, lambda t: F.array(at + t * period, t * period - at)))
        spots = F.when(n == 1, F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))).otherwise(F.array_distinct(all_))
        return F.explode(F.filter(spots, lambda p: (p >= -reach) & (p < n + reach)))

    rows = pixels.join(sizes(pixels, keys), keys)
    rows = rows.withColumn("y", images(F.col("y").cast("long"), F.col("height").cast("long"))).withColumn("x", images(F.col("x").cast("long"), F.col("width").cast("long")))
    return rows.select(*pixels.columns)


def local_variance(pixels: DataFrame, keys: list[str], window: int = VARIANCE_WINDOW) -> DataFrame:
    """keys, y, x, v, variance: of the window around each pixel, mirrored at the edges."""
    reach, n = window // 2, window * window
    v = F.col("v").cast("long")
    rows = box_sums(padded(pixels.select(*keys, "y", "x", "v"), keys, reach), keys, reach, s1=v, s2=v * v)
    rows = rows.join(sizes(pixels, keys), keys).where("y >= 0 and y < height and x >= 0 and x < width")
    return rows.select(*keys, "y", "x", "v", ((n * F.col("s2") - F.col("s1") * F.col("s1")) / (n * n)).alias("variance"))


def beside(value: Column, w: Window, step: int) -> Column:
    """The neighbour one step before (-1) or behind along w, the other one at the edge."""
    near, far = (F.lag, F.lead) if step < 0 else (F.lead, F.lag)
    return F.coalesce(near(value).over(w), far(value).over(w), value)


def slopes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v, gx, gy (Sobel), lap (Laplacian) of 3 x 3, mirrored at the edges."""
    row, column = along(keys, "x"), along(keys, "y")
    v = F.col("v").cast("long")
    rows = pixels.select(*keys, "y", "x", "v", beside(v, row, -1).alias("l"), beside(v, row, 1).alias("r"))
    rows = rows.withColumns({"d": F.col("r") - F.col("l"), "g": F.col("l") + 2 * v + F.col("r")})
    up, down = (lambda c: beside(F.col(c), column, -1)), (lambda c: beside(F.col(c), column, 1))
    return rows.select(*keys, "y", "x", "v", (up("d") + 2 * F.col("d") + down("d")).alias("gx"), (down("g") - up("g")).alias("gy"), (F.col("l") + F.col("r") + up("v") + down("v") - 4 * v).alias("lap"))


def spread(pixels: DataFrame, keys: list[str], column: str, reach: int, grow: bool, axes: str = "xy") -> DataFrame:
    """pixels with column's largest (grow) or smallest value over windows of 2 * reach + 1 squared, cut at the edges.

    The square is a row of columns: one pass along each axis, in the order of axes.
    """
    pick = F.max if grow else F.min
    for axis in axes:
        pixels = pixels.withColumn(column, pick(column).over(along(keys, axis).rowsBetween(-reach, reach)))
    return pixels


def opened(pixels: DataFrame, keys: list[str], column: str, window: int = 5, times: int = 1) -> DataFrame:
    """Shrunk, then grown: what is smaller than the window goes. Times shrinks of a square are one of that many reaches."""
    reach = window // 2 * times
    return spread(spread(pixels, keys, column, reach, False, "xy"), keys, column, reach, True, "yx")


def closed(pixels: DataFrame, keys: list[str], column: str, window: int = 5, times: int = 1) -> DataFrame:
    """Grown, then shrunk: gaps smaller than the window are filled."""
    reach = window // 2 * times
    return spread(spread(pixels, keys, column, reach, True, "xy"), keys, column, reach, False, "yx")


def runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, run, x0, x1: maximal runs along rows of the pixels in mask (keys, y, x); run is unique in a row."""
    lane = F.col("x") - F.row_number().over(along(keys, "x"))
    return mask.withColumn("run", lane).groupBy(*keys, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))


def labelled_runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """runs() of mask with label: one for each part connected over sides or corners; its value has no meaning.

    Runs of neighbouring rows that touch are linked where they meet in cells of CELL columns, and links are followed by
    components(). Pixels count once; a picture without a pixel in mask has no row.
    """
    own = settled(runs(mask.select(*keys, "y", "x").distinct(), keys).withColumn("_node", F.monotonically_increasing_id()))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / CELL).cast("long"), F.floor(b / CELL).cast("long")))
    upper = own.select(*keys, (F.col("y") + 1).alias("y"), F.col("_node").alias("_a"), (F.col("x0") - 1).alias("_from"), (F.col("x1") + 1).alias("_to"), cells(F.col("x0") - 1, F.col("x1") + 1).alias("_cell"))
    lower = own.select(*keys, "y", F.col("_node").alias("_b"), "x0", "x1", cells(F.col("x0"), F.col("x1")).alias("_cell"))
    links = upper.join(lower, [*keys, "y", "_cell"]).where("x0 <= _to and x1 >= _from").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    of = components(links).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return own.join(of, "_node", "left").select(*keys, "y", "run", "x0", "x1", F.coalesce("_root", "_node").alias("label"))


def component_table(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first_y, first_x, area, y0, y1, x0, x1 of each connected part; its first pixel in reading order names it."""
    rows = labelled_runs(mask, keys).groupBy(*keys, "label").agg(
        F.min(F.struct("y", "x0")).alias("first"), F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")
    )
    return rows.select(*keys, F.col("first.y").alias("first_y"), F.col("first.x0").alias("first_x"), "area", "y0", "y1", "x0", "x1")


def large_parts(pixels: DataFrame, keys: list[str], column: str, least: Column, most: Column) -> DataFrame:
    """pixels with column (0 or 1) set to 0 outside connected parts of least to most pixels; both are of keys and size columns."""
    found = labelled_runs(pixels.where(F.col(column) == 1), keys)
    area = found.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    good = area.join(sizes(pixels, keys), keys).where((F.col("area") >= least) & (F.col("area") <= most)).select(*keys, "label")
    spots = found.join(good, [*keys, "label"]).select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(1).alias("in"))
    return pixels.join(spots, [*keys, "y", "x"], "left").withColumn(column, F.coalesce("in", F.lit(0))).drop("in")


def damaged(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v, hit (0 or 1): dark, white or flat gray areas, cleaned of specks and limited in area.

    The limit of darkness follows the picture's own fifth hundredth where its median is below 60. Gray counts only in a
    picture whose Laplacian hardly varies.
    """
    own = pixels.select(*keys, "y", "x", "v")
    dark = own.groupBy(*keys).agg(F.percentile("v", 0.05).alias("p5"), F.percentile("v", 0.5).alias("p50"))
    flat = slopes(own, keys).groupBy(*keys).agg(F.var_pop("lap").alias("rough"))
    limit = F.greatest(F.lit(8.0), F.least(F.lit(30.0), F.when(F.col("p50") < 60, F.col("p5") * 0.6).otherwise(float(DARK))))
    rows = own.join(dark.join(flat, keys), keys)
    hit = (F.col("v") < limit) | (F.col("v") > 253) | ((F.col("v") > 120) & (F.col("v") < 135) & (F.col("rough") < 5.0))
    rows = closed(opened(rows.select(*keys, "y", "x", "v", hit.cast("int").alias("hit")), keys, "hit"), keys, "hit", times=2)
    whole = F.col("height") * F.col("width")
    return large_parts(settled(rows), keys, "hit", F.greatest(F.lit(LEAST_AREA), F.floor(whole * LEAST_SHARE)), F.floor(whole * MOST_SHARE))


def fused(pixels: DataFrame, keys: list[str], masks: list[str], votes: int = 2, least_area: int = 200, most_share: float = 0.30) -> DataFrame:
    """keys, y, x, votes, hit: pixels where so many of the masks (columns of 0 or 1) agree, closed, grown, cleaned.

    Pictures of less than SMALL_PICTURE pixels are neither closed nor grown, and the least area is a hundredth of the picture
    if that is less. A mask over most_share of its picture is dropped whole.
    """
    n = sum((F.col(m) for m in masks[1:]), F.col(masks[0]))
    rows = pixels.join(sizes(pixels, keys).select(*keys, (F.col("height") * F.col("width")).alias("whole")), keys)
    rows = rows.select(*keys, "y", "x", "whole", n.alias("votes"), (n >= votes).cast("int").alias("raw")).withColumn("hit", F.col("raw"))
    rows = spread(closed(rows, keys, "hit"), keys, "hit", 2, True)
    rows = settled(rows.withColumn("hit", F.when(F.col("whole") >= SMALL_PICTURE, F.col("hit")).otherwise(F.col("raw"))).drop("raw"))
    whole = F.col("height") * F.col("width")
    kept = large_parts(rows, keys, "hit", F.least(F.lit(least_area), F.greatest(F.lit(1), F.floor(whole / 100))), whole)
    share = kept.groupBy(*keys).agg(F.avg("hit").alias("share"))
    return kept.join(share, keys).select(*keys, "y", "x", "votes", F.when(F.col("share") > most_share, 0).otherwise(F.col("hit")).alias("hit"))


def fusion_scores(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, agreement, area_ratio, confidence of a fused mask (keys, votes, hit)."""
    rows = mask.groupBy(*keys).agg(F.avg((F.col("votes") >= 2).cast("double")).alias("agreement"), F.avg(F.col("hit").cast("double")).alias("area_ratio"))
    size = F.when(F.col("area_ratio") <= 0.15, 1.0).when(F.col("area_ratio") <= 0.30, 0.7).when(F.col("area_ratio") <= 0.50, 0.4).otherwise(0.1)
    return rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("agreement") + 0.4 * size)))


# ---- perceptual hashes ----

#: Bits along a side of a hash; pixels along a side of the picture that its frequencies are taken from.
HASH_SIDE, FREQUENCY_SIDE = 8, 32


def resized(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """keys, y, x, v: means over equal areas of the picture, height by width of them, rounded half to even.

    A pixel counts in each area by the part of it that lies there; parts are whole numbers of the product of both sizes, so
    the sums are exact.
    """

    def areas(at: str, size: str, n: int) -> Column:
        low, high = F.col(at) * n, (F.col(at) + 1) * n
        first, last = F.floor(low / F.col(size)).cast("long"), (F.ceil(high / F.col(size)) - 1).cast("long")
        part = lambda i: F.least(high, (i + 1) * F.col(size)) - F.greatest(low, i * F.col(size))
        return F.explode(F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), part(i).alias("part"))))

    rows = pixels.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v")).join(sizes(pixels, keys), keys)
    rows = rows.withColumn("a", areas("y", "height", height)).withColumn("b", areas("x", "width", width))
    rows = rows.groupBy(*keys, F.col("a.i").alias("y"), F.col("b.i").alias("x")).agg(F.sum(F.col("a.part") * F.col("b.part") * F.col("v")).alias("s"), F.first(F.col("height") * F.col("width")).alias("n"))
    return rows.select(*keys, "y", "x", F.rint(F.col("s") / F.col("n")).cast("long").alias("v"))


def hex_of(bits: Column) -> Column:
    """Hexadecimal digits of a string of 64 bits."""
    return F.lpad(F.lower(F.conv(bits, 2, 16)), 16, "0")


def difference_hash(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dhash: whether each of 8 x 9 areas is brighter than the next to its right, as 16 hex digits."""
    small = resized(pixels, keys, HASH_SIDE, HASH_SIDE + 1)
    up = small.withColumn("up", F.col("v") > F.lead("v").over(along(keys, "x"))).where("up is not null")
    bits = up.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col("up").cast("int").alias("b")))), lambda e: e["b"].cast("string")), "").alias("bits"))
    return bits.select(*keys, hex_of(F.col("bits")).alias("dhash"))


def frequency_hash(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phash: the 8 x 8 lowest frequencies of 32 x 32 areas against their mean without the first, as 16 hex digits.

    Cosine sums are taken along rows, then columns; frequencies are compared to six places.
    """
    n, last = FREQUENCY_SIDE, HASH_SIDE
    basis = lambda c, k: F.cos((2 * F.col(c) + 1) * (k * 3.141592653589793 / (2 * n))) * (0.5**0.5 if k == 0 else 1.0)
    rows = resized(pixels, keys, n, n).groupBy(*keys, "y").agg(*[F.sum(F.col("v") * basis("x", k)).alias(f"c{k}") for k in range(last)])
    low = rows.groupBy(*keys).agg(F.array(*[F.round(F.sum(F.col(f"c{k}") * basis("y", j)) * (2 / n), 6) for j in range(last) for k in range(last)]).alias("low"))
    mean = F.round((F.aggregate("low", F.lit(0.0), lambda a, x: a + x) - F.col("low")[0]) / (last * last - 1), 6)
    bits = F.array_join(F.transform("low", lambda x: (x > F.col("mean")).cast("int").cast("string")), "")
    return low.withColumn("mean", mean).select(*keys, hex_of(bits).alias("phash"))
