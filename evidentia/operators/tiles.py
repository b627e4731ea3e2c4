"""All pairs of rows by tiles: rows are dealt to blocks, each pair of blocks meets in one task, which goes over it in strips."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block at most, rows under which it isn't cut further, and rows of both sides of a strip.
BLOCK_BYTES, LEAST_ROWS, STRIP = 64 << 20, 2048, (1024, 4096)
#: Tasks a core.
WAVES = 3


def count_of(rows: DataFrame, n: int, width: int) -> int:
    """Blocks for n rows of so many bytes: enough for every core, and as many as their size asks for; so a row moves as often
    at any number of rows, until blocks are full."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n * width // BLOCK_BYTES), min(math.ceil(math.sqrt(2 * WAVES * cores)), -(-n // LEAST_ROWS)))


def triangle(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """rows, each once for every block that its own meets, with tile, second (side in it) and same (both sides are one), a partition a tile."""
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    both = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tile = (F.floor(high * (high + 1) / 2) + low).cast("int")
    return both.select(*rows.columns, tile.alias("tile"), (F.col("block") > F.col("other")).alias("second"), (F.col("block") == F.col("other")).alias("same")).repartitionById(n * (n + 1) // 2, "tile")


def crossed(queries: DataFrame, rows: DataFrame, key: Column, n: int) -> DataFrame:
    """Queries, once for each of n blocks of rows, and rows of the same columns, with tile and second, a partition a tile."""
    every = queries.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("second", F.lit(False))
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("second", F.lit(True))
    return every.unionByName(dealt).repartitionById(n, "tile")


def tables(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A partition's tile as one table."""
    found = list(batches)
    return pa.Table.from_batches(found).combine_chunks() if found else None


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """First and second side of a tile; one that meets itself is both."""
    second = table["second"].to_numpy()
    if "same" in table.column_names and table["same"][0].as_py():
        return table, table
    return table.filter(pa.array(~second)), table.filter(pa.array(second))


def matrix(table: pa.Table, column: str, width: int) -> np.ndarray:
    """A column of arrays without nulls as rows of doubles, short ones filled with 0."""
    if not len(table):
        return np.zeros((0, width))
    values = table[column].combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    lengths, flat = values.value_lengths().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def strips(n: int, m: int, same: bool) -> Iterator[tuple[slice, slice]]:
    """Strips of n x m pairs; where both sides are one, only those with a pair on or above the diagonal."""
    for s in range(0, n, STRIP[0]):
        for t in range(s // STRIP[1] * STRIP[1] if same else 0, m, STRIP[1]):
            yield slice(s, min(n, s + STRIP[0])), slice(t, min(m, t + STRIP[1]))


def close(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of a and b, of length 1 or 0, whose dot product is `least` or more, a strip at a time; i < j if both are one.

    Products are first taken in single precision; those that its error leaves open are taken again in double.
    """
    x, y = a.astype(np.float32), b.astype(np.float32)
    error = 2.0**-22 * (a.shape[1] + 4)
    for s, t in strips(len(a), len(b), same):
        product = x[s] @ y[t].T
        k = np.flatnonzero(product > least - error)
        i, j = k // product.shape[1], k % product.shape[1]
        open_ = product[i, j] < least + error
        i, j = i + s.start, j + t.start
        keep = i < j if same else np.ones(len(i), bool)
        open_ &= keep
        keep[open_] = np.einsum("ij,ij->i", a[i[open_]], b[j[open_]]) >= least
        yield i[keep], j[keep]


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (each place's smallest known linked place) after links between places i and j."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
