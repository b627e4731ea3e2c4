"""Fragments: greedy chains per dump, density clusters of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clustering
from .filters import chance


def overlap(a: bytes, b: bytes, window: int = 32) -> float:
    """How well two ends of equal length go on: alike edges, shared windows."""
    tail, head = (np.frombuffer(x, np.uint8).astype(float) for x in (a, b))
    cut = lambda x: {x[i : i + window] for i in range(len(x) - window + 1)}
    one, two = cut(a), cut(b)
    return 0.65 * max(0.0, 1 - float(((tail - head) ** 2).mean()) / 255**2) + 0.35 * len(one & two) / max(len(one), len(two))


def continuity(a: bytes, b: bytes, reach: int = 64, window: int = 32) -> float:
    """How well b goes on where a ends: alike edges, shared windows, like sizes."""
    over = overlap(a[-reach:], b[:reach], window) if min(len(a), len(b)) >= reach else 0.0
    return 0.7 * over + 0.3 * min(len(a), len(b)) / max(1, len(a), len(b))


REACH, WINDOW = 64, 32
CHAIN = "dump_id long, place long, idx long, continuity double"


def hashed_windows(ends: np.ndarray) -> np.ndarray:
    """[..., REACH] bytes -> a hash of each WINDOW of them: equal windows have equal hashes."""
    w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ends, WINDOW, -1)).view(np.uint64)
    out = np.zeros(w.shape[:-1], np.uint64)
    for i in range(w.shape[-1]):
        out = (out ^ w[..., i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def chains(idx: np.ndarray, size: np.ndarray, head: list[list[bytes]], tail: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(order, continuity) [dumps, places] of dumps of equally many fragments, in order of offset: all take a step at a time.

    Windows are compared by hash; where any agrees, overlap() decides.
    """
    n, m = size.shape
    ends = [np.frombuffer(b"".join(x.ljust(REACH, b"\0") for row in side for x in row), np.uint8).reshape(n, m, REACH) for side in (head, tail)]
    first, last = (hashed_windows(e) for e in ends)
    row, order, score = np.arange(n), np.zeros((n, m), np.int64), np.full((n, m), np.nan)
    free = np.ones((n, m), bool)
    free[:, 0] = False
    for place in range(1, m):
        at = order[:, place - 1]
        both = (size >= REACH) & (size[row, at] >= REACH)[:, None]
        gap = ((ends[1][row, at].astype(float)[:, None] - ends[0]) ** 2).mean(2)
        less, more = np.minimum(size, size[row, at][:, None]), np.maximum(size, size[row, at][:, None])
        fit = 0.7 * np.where(both, 0.65 * np.maximum(0.0, 1 - gap / 255**2), 0.0) + 0.3 * less / np.maximum(1, more)
        shared = both & free & (last[row, at][:, None, :, None] == first[:, :, None, :]).any((2, 3))
        for d, j in zip(*np.nonzero(shared), strict=True):
            fit[d, j] = 0.7 * overlap(tail[d][at[d]], head[d][j]) + 0.3 * less[d, j] / max(1, more[d, j])
        best = np.where(free, fit, -1.0).argmax(1)
        order[:, place], score[:, place], free[row, best] = best, fit[row, best], False
    return idx[row[:, None], order], score


def greedy_chain(fragments: DataFrame) -> DataFrame:
    """(dump_id, idx, off, data) -> dump_id, place, idx, continuity: from the lowest offset, the best follower each time.

    A dump is a row of its fragments' sizes and ends; a batch's dumps of equally many fragments are walked together.
    """
    data = F.coalesce("data", F.lit(b""))
    size = F.octet_length(data)
    ends = F.struct("off", "idx", size.cast("long").alias("size"), F.substring(data, 1, REACH).alias("head"), F.substring(data, F.greatest(F.lit(1), size - REACH + 1), F.lit(REACH)).alias("tail"))
    dumps = fragments.groupBy("dump_id").agg(F.array_sort(F.collect_list(ends)).alias("f"))
    dumps = dumps.select("dump_id", *[F.col(f"f.{c}").alias(c) for c in ("idx", "size", "head", "tail")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count = batch["idx"].map(len).to_numpy()
            for m in np.unique(count):
                own = batch[count == m]
                step = max(1, (1 << 14) // int(m))
                for part in (own[i : i + step] for i in range(0, len(own), step)):
                    idx, size = (np.stack(part[c].to_list()).astype(np.int64) for c in ("idx", "size"))
                    order, score = chains(idx, size, *[[[bytes(x) for x in row] for row in part[c]] for c in ("head", "tail")])
                    yield pd.DataFrame({"dump_id": np.repeat(part["dump_id"].to_numpy(), m), "place": np.tile(np.arange(m), len(part)), "idx": order.ravel(), "continuity": pd.array(score.ravel(), "Float64")})

    return dumps.mapInPandas(run, CHAIN)


def clusters(vectors: DataFrame, eps: float = 0.3, least: int = 2) -> DataFrame:
    """Density clusters of (vec_id, embedding) under cosine distance: vec_id, cluster (smallest core id reachable, -1: noise)."""
    found = clustering.clusters(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), eps, least)
    return found.withColumnRenamed("id", "vec_id")


#: Shorter fragments are rejected.
LEAST_FRAGMENT = 8


def judged(fragments: DataFrame, least: int = LEAST_FRAGMENT) -> DataFrame:
    """(dump_id, idx, off, data) with size, sha256 and reason: null, too_small, or duplicate of an earlier one by offset and index.

    Fragments without data are too small.
    """
    rows = fragments.withColumns({"size": F.coalesce(F.octet_length("data"), F.lit(0)).cast("long"), "sha256": F.sha2(F.coalesce("data", F.lit(b"")), 256)})
    again = F.row_number().over(Window.partitionBy("dump_id", "sha256").orderBy("off", "idx")) > 1
    return rows.withColumn("reason", F.when(F.col("size") < least, "too_small").when(again, "duplicate"))


def assembled(chain: DataFrame) -> DataFrame:
    """Files put together: dump_id, fragments, size, sha256, score, gaps, running, data. One row a dump, any number of fragments.

    chain: dump_id, place (their order, unique in a dump), off, size, sha256, data, and continuity (null counts as 1, for the
    first). gaps are the bytes of the dump between one fragment's end and the next one's start, where that is behind; running is
    a digest chained over the fragments' own, so that of two files that differ the first fragment that does can be found.
    The bytes of a file meet in one row, as the file must; longer than 2 GB is an error of the aggregate.
    """
    ends = Window.partitionBy("dump_id").orderBy("place")
    rows = chain.withColumn("gap", F.greatest(F.lit(0).cast("long"), F.col("off") - F.lag(F.col("off") + F.col("size")).over(ends)))
    whole = rows.groupBy("dump_id").agg(
        F.count("*").alias("fragments"), F.sum("size").alias("size"), F.avg(F.coalesce("continuity", F.lit(1.0))).alias("score"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gaps"),
        F.array_sort(F.collect_list(F.struct("place", "sha256"))).alias("list"), F.expr("listagg(data) WITHIN GROUP (ORDER BY place)").alias("data"),
    )
    running = F.aggregate("list", F.lit(""), lambda a, x: F.sha2(F.concat(a, x["sha256"]).cast("binary"), 256))
    data = F.coalesce("data", F.lit(b""))
    return whole.select("dump_id", "fragments", "size", F.sha2(data, 256).alias("sha256"), "score", "gaps", running.alias("running"), data.alias("data"))


def report(fragments: DataFrame, chain: DataFrame, source: DataFrame) -> DataFrame:
    """One row a dump of source (dump_id, content): what was found, used and rejected, and the file that came of it.

    fragments as judged() gives them, chain as assembled() takes it. Dumps without fragments have an empty list each and an
    empty file of score 0.
    """
    lists = fragments.groupBy("dump_id").agg(
        F.count("*").alias("total_fragments"), F.array_sort(F.collect_list(F.struct("off", "idx", "size", "sha256"))).alias("offsets"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("off", "idx", "size", "reason", "sha256")))).alias("fragments_rejected"),
    )
    used = chain.groupBy("dump_id").agg(F.array_sort(F.collect_list(F.struct("place", "idx", "off", "size", F.coalesce("continuity", F.lit(1.0)).alias("continuity"), "sha256"))).alias("fragments_used"))
    rows = source.select("dump_id", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("sha256_dump")).join(lists, "dump_id", "left").join(used, "dump_id", "left").join(assembled(chain), "dump_id", "left")
    nothing = F.sha2(F.lit(b""), 256)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<struct<{kind}>>"))
    return rows.select(
        "dump_id", "sha256_dump", F.coalesce("total_fragments", F.lit(0)).alias("total_fragments"), F.coalesce("fragments", F.lit(0)).alias("used_fragments"), F.size(empty(F.col("fragments_rejected"), "off:bigint,idx:bigint,size:bigint,reason:string,sha256:string")).cast("long").alias("rejected_fragments"),
        empty(F.col("offsets"), "off:bigint,idx:bigint,size:bigint,sha256:string").alias("offsets"), empty(F.col("fragments_used"), "place:bigint,idx:bigint,off:bigint,size:bigint,continuity:double,sha256:string").alias("fragments_used"),
        empty(F.col("fragments_rejected"), "off:bigint,idx:bigint,size:bigint,reason:string,sha256:string").alias("fragments_rejected"),
        F.struct(F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("sha256", nothing).alias("sha256"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("running", F.lit("")).alias("running")).alias("assembly"), F.coalesce("score", F.lit(0.0)).alias("assembly_score"),
    )


def scattered(dumps: DataFrame, pieces: int = 6, loss: float = 0.2, noise: int = 512, seed: int = 42) -> DataFrame:
    """Ground truth of dumps (dump_id, content) cut up: dump_id, idx, source_offset, size, sha256, lost, place, dump_offset, data.

    Cuts lie within a quarter of a piece's length around even ones; about the share `loss` of the pieces is lost; the others
    are shuffled, each behind `noise` bytes of noise, and have a place and an offset in the new dump. All chance comes from
    dump_id and seed, so a rerun gives the same. Null contents are empty: their pieces are, too.
    """
    n = F.octet_length("content").cast("long")
    rows = dumps.select("dump_id", F.coalesce("content", F.lit(b"")).alias("content"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("idx"))
    dice = lambda k, which: chance(F.col("dump_id"), seed, k, F.lit(which))
    cut = lambda k: F.when(k <= 0, 0).when(k >= pieces, n).otherwise(F.floor(k * n / pieces + (dice(k, 0) - 0.5) * n / pieces / 2)).cast("long")
    rows = rows.withColumns({"source_offset": cut(F.col("idx")), "next": cut(F.col("idx") + 1)}).withColumn("size", F.col("next") - F.col("source_offset"))
    data = F.substring("content", (F.col("source_offset") + 1).cast("int"), F.col("size").cast("int"))
    rows = rows.select("dump_id", "idx", "source_offset", "size", data.alias("data"), (dice(F.col("idx"), 1) < loss).alias("lost"), dice(F.col("idx"), 2).alias("shuffled"))
    kept = Window.partitionBy("dump_id", "lost").orderBy("shuffled", "idx")
    before = F.coalesce(F.sum(F.col("size") + noise).over(kept.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("dump_id", "idx", "source_offset", "size", F.sha2("data", 256).alias("sha256"), "lost", F.when(~F.col("lost"), F.row_number().over(kept)).cast("long").alias("place"), F.when(~F.col("lost"), before + noise).cast("long").alias("dump_offset"), "data")


def dumped(truth: DataFrame, noise: int = 512) -> DataFrame:
    """(dump_id, content): the pieces of scattered() that are left, in their places, noise before each; dumps that lost all are left out."""
    word = F.sha2(F.concat_ws(":", "dump_id", "idx").cast("binary"), 256)
    loud = F.unhex(F.substring(F.repeat(word, noise // 32 + 1), 1, 2 * noise))
    rows = truth.where("not lost").select("dump_id", "place", F.concat(loud, F.col("data")).alias("data"))
    return rows.groupBy("dump_id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY place)").alias("content"))
