"""Fragments' features and density clusters: 107 numbers a picture, neighbours by tiles of pairs, labels by core links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles
from .settled import components, settled

# Fixed values of the features.
HISTOGRAM_BINS, ENTROPY_BINS, LEAST_BLOCK, BLOCKS = 32, 16, 8, 8
GRAY = {"r": 4899, "g": 9617, "b": 1868}
GRAY_SHIFT = 14
#: Rounding of a distance, which counts as within.
ERROR = 1e-12
NOISE = -1


def features(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and features (array of 107 doubles) of colour pictures (keys, y, x, b, g, r).

    For b, g and r the shares of 32 bins of values; for each the mean and deviation over 255 and the skewness over 10, from -1
    to 1; the mean entropy of gray blocks over 4; the variance of gray over 255 squared. Blocks are an eighth of the
    shorter side, 8 pixels at least, and none touches the lower or right edge. Moments come from exact sums.
    """
    channels = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.col(c).cast("long").alias("v")) for i, c in enumerate("bgr")]))
    v = F.col("c.v")
    big = lambda c: c.cast("decimal(38,0)")
    per = pixels.select(*keys, channels.alias("c")).groupBy(*keys, "c.channel").agg(
        F.count("*").alias("n"), *[F.count_if(F.floor(v / (256 // HISTOGRAM_BINS)) == k).alias(f"h{k}") for k in range(HISTOGRAM_BINS)], F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.sum(v * v * v).alias("s3")
    )
    n, s1, s2, s3 = (F.col(c) for c in ("n", "s1", "s2", "s3"))
    deviation = F.sqrt((n * s2 - s1 * s1).cast("double")) / n
    third = (big(n) * big(n) * s3 - 3 * big(n) * s1 * s2 + 2 * big(s1) * s1 * s1).cast("double") / (n.cast("double") * n * n)
    skew = third / ((deviation + 1e-9) * (deviation + 1e-9) * (deviation + 1e-9))
    per = per.select(*keys, "channel", F.array(*[F.col(f"h{k}") / (n + 1e-9) for k in range(HISTOGRAM_BINS)]).alias("bins"), F.array(s1 / n / 255, deviation / 255, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), skew / 10))).alias("moments"))
    of = lambda c, k: F.max(F.when(F.col("channel") == k, F.col(c)))
    colour = per.groupBy(*keys).agg(F.concat(*[of("bins", k) for k in range(3)], *[of("moments", k) for k in range(3)]).alias("colour"))
    gray = F.shiftright(sum((F.col(c).cast("long") * w for c, w in GRAY.items()), F.lit(1 << (GRAY_SHIFT - 1))), GRAY_SHIFT)
    light = pixels.select(*keys, "y", "x", gray.alias("v"))
    whole = light.groupBy(*keys).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.var_pop("v") / 255**2).alias("variance"))
    size = F.greatest(F.lit(LEAST_BLOCK), F.floor(F.least("height", "width") / BLOCKS))
    blocks = light.join(whole, keys).withColumns({"size": size}).withColumns({"by": F.floor(F.col("y") / F.col("size")), "bx": F.floor(F.col("x") / F.col("size"))})
    blocks = blocks.where("(by + 1) * size < height and (bx + 1) * size < width").groupBy(*keys, "by", "bx", F.floor(F.col("v") / (256 // ENTROPY_BINS)).alias("bin")).agg(F.count("*").alias("k"), F.first("size").alias("size"))
    share = F.col("k") / (F.col("size") * F.col("size") + 1e-9)
    entropy = blocks.groupBy(*keys, "by", "bx").agg(F.sum(-share * F.log2(share + 1e-9)).alias("e")).groupBy(*keys).agg((F.avg("e") / 4).alias("entropy"))
    rows = colour.join(whole.select(*keys, "variance"), keys).join(entropy, keys, "left")
    return rows.select(*keys, F.concat("colour", F.array(F.coalesce("entropy", F.lit(0.0)), F.col("variance"))).alias("features"))


def unit(vector: Column) -> Column:
    """The vector of length 1; a null or zero one as it is. Its length is bound to a variable, so it is computed once."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))), F.lit(0))


def beside(dealt: DataFrame, eps: float, width: int) -> DataFrame:
    """(id, beside): weight of the others within eps of a vector, tile by tile, of tiles of (id, u, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = tiles.tables(batches)
        if tile is None or not len(tile):
            return
        (one, two), same = tiles.sides(tile), tile["same"][0].as_py()
        weights, lengths = [x["weight"].to_numpy() for x in (one, two)], [pc.list_value_length(x["u"]).to_numpy() for x in (one, two)]
        sums = [np.zeros(len(x), np.int64) for x in weights]
        for i, j in tiles.close(tiles.matrix(one, "u", width), tiles.matrix(two, "u", width), 1 - eps - ERROR, same):
            keep = lengths[0][i] == lengths[1][j]
            np.add.at(sums[0], i[keep], weights[1][j[keep]])
            np.add.at(sums[0 if same else 1], j[keep], weights[0][i[keep]])
        for side, n in zip((one, two), sums, strict=True):
            if n.any():
                yield pa.RecordBatch.from_arrays([pa.array(side["id"].to_numpy()[n > 0]), pa.array(n[n > 0])], ["id", "beside"])

    return dealt.mapInArrow(run, "id long, beside long").groupBy("id").agg(F.sum("beside").alias("beside"))


def links(dealt: DataFrame, eps: float, width: int) -> DataFrame:
    """(a, b, linked) of tiles of (id, u, core): linked core vectors, of a tile only as many links as connect them, and, not
    linked, all pairs of another vector a with a core one b within eps; a vector that isn't core has few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = tiles.tables(batches)
        if tile is None or not len(tile):
            return
        (one, two), same = tiles.sides(tile), tile["same"][0].as_py()
        n = 0 if same else len(one)
        ids, core = (np.concatenate([x[c].to_numpy(zero_copy_only=False) for x in ((one,) if same else (one, two))]) for c in ("id", "core"))
        lengths = [pc.list_value_length(x["u"]).to_numpy() for x in (one, two)]
        root = np.arange(len(ids))
        for i, j in tiles.close(tiles.matrix(one, "u", width), tiles.matrix(two, "u", width), 1 - eps - ERROR, same):
            keep = lengths[0][i] == lengths[1][j]
            i, j = i[keep], j[keep] + n
            inner = core[i] & core[j]
            root = tiles.merge(root, i[inner], j[inner])
            edge = core[i] != core[j]
            i, j = np.where(core[i], j, i)[edge], np.where(core[i], i, j)[edge]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(np.zeros(len(i), bool))], ["a", "b", "linked"])
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]]), pa.array(np.ones(len(moved), bool))], ["a", "b", "linked"])

    return dealt.mapInArrow(run, "a long, b long, linked boolean")


def clusters(vectors: DataFrame, eps: float = 0.3, least: int = 2) -> DataFrame:
    """(id, cluster) of vectors (id, vector): density clusters under cosine distance, named by their smallest core id.

    A vector is core if with itself `least` or more lie within eps. Core neighbours share a cluster, others join that of
    smallest name beside them, or are noise (-1), as are null vectors and ones with a null. Equal vectors are compared as one
    and fare alike, but count each. All pairs of vectors are compared, tile by tile, for the weights beside and again for the
    links; no pair leaves its task but those that connect something.
    """
    rows = settled(vectors.select(F.col("id").cast("long").alias("id"), unit(F.col("vector")).alias("u")))
    once = settled(rows.where("u is not null and not exists(u, x -> x is null)").groupBy("u").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    n, width = once.select(F.count("*"), F.max(F.size("u"))).first()
    if not width:
        return rows.select("id", F.lit(NOISE).cast("long").alias("cluster"))
    blocks = tiles.count_of(once, n, 8 * width)
    around = beside(tiles.triangle(once, F.col("id"), blocks), eps, width)
    judged = once.join(around, "id", "left").select("id", "u", (F.col("weight") + F.coalesce("beside", F.lit(0)) >= least).alias("core"))
    judged = settled(judged)
    found = settled(links(tiles.triangle(judged, F.col("id"), blocks), eps, width))
    of = components(found.where("linked").select("a", "b"))
    named = settled(judged.where("core").select("id").join(of.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster")))
    edge = found.where("not linked").join(named.select(F.col("id").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("beside"))
    found = once.join(named, "id", "left").join(edge.withColumnRenamed("a", "id"), "id", "left").select("u", F.coalesce("cluster", "beside", F.lit(NOISE)).cast("long").alias("cluster"))
    return rows.join(found, "u", "left").select("id", F.coalesce("cluster", F.lit(NOISE).cast("long")).alias("cluster"))


#: Decimals of a distance in searches.
DECIMALS = 9


def looked_up(queries: DataFrame, vectors: DataFrame, eps: float) -> DataFrame:
    """(id, near, distance, other) of each query with a vector to compare: other vectors within eps, and the nearest, ties to the smallest id.

    queries, vectors: id, vector. Distances are cosine distances, rounded to DECIMALS; a zero vector is 1 from all. A null
    in a vector, and what it lacks of the longest one's length, is 0; vectors without a number match nothing. All queries are
    compared with all vectors, block by block; a block's best goes on.
    """
    plain = lambda df: df.select(F.col("id").cast("long").alias("id"), unit(F.transform("vector", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))).alias("u"), F.exists("vector", lambda x: x.isNotNull()).alias("some")).where("some").drop("some")
    rows, asked = plain(vectors), plain(queries)
    (n, width), (n_asked, width_asked) = (df.where("vector is not null").select(F.count("*"), F.max(F.size("vector"))).first() for df in (vectors, queries))
    width = max(width or 0, width_asked or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = tiles.tables(batches)
        if tile is None or not len(tile):
            return
        one, two = tiles.sides(tile)
        a, b, ids = tiles.matrix(one, "u", width), tiles.matrix(two, "u", width), one["id"].to_numpy()
        order = np.argsort(two["id"].to_numpy(), kind="stable")
        b, others = b[order], two["id"].to_numpy()[order]
        for s, t in tiles.strips(len(a), len(b), False):
            distance = 1 - a[s] @ b[t].T
            first, last = (np.searchsorted(others[t], ids[s], side) for side in ("left", "right"))
            for q in np.flatnonzero(last > first):
                distance[q, first[q] : last[q]] = np.inf
            distance[np.isnan(distance)] = np.inf
            least = distance.min(axis=1)
            q, k = np.nonzero(distance <= (least + 2 * 10.0**-DECIMALS)[:, None])
            exact = np.round(distance[q, k], DECIMALS)
            best = np.lexsort((k, exact, q))
            best = best[np.unique(q[best], return_index=True)[1]]
            best = best[np.isfinite(exact[best])]
            near = np.count_nonzero(distance < eps + 0.5 * 10.0**-DECIMALS, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s][q[best]]), pa.array(near[q[best]]), pa.array(exact[best]), pa.array(others[t][k[best]])], ["id", "near", "distance", "other"])

    if not width:
        return asked.select("id", F.lit(0).cast("long").alias("near"), F.lit(0.0).alias("distance"), "id").where("false").toDF("id", "near", "distance", "other")
    # queries are sent to every block, so there are as many as cores need and no more
    blocks = tiles.count_of(rows, n, 8 * width)
    parts = max(blocks, -(-n_asked * 8 * width // tiles.BLOCK_BYTES))
    found = tiles.crossed(asked, rows, F.col("id"), parts).mapInArrow(run, "id long, near long, distance double, other long")
    return found.groupBy("id").agg(F.sum("near").alias("near"), F.min(F.struct("distance", "other")).alias("best")).select("id", "near", "best.distance", "best.other")


def rollup(labels: DataFrame) -> DataFrame:
    """(cluster, size, first_id, last_id, coherence): each cluster, noise too; coherence is the share of ids in a cluster."""
    share = labels.agg(F.round(F.try_divide(F.count_if(F.col("cluster") != NOISE), F.count("*")), 3)).first()[0]
    rows = labels.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return rows.withColumn("coherence", F.lit(share).cast("double"))
