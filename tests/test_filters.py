"""Filters and damage on pixel relations against NumPy."""

import math

import numpy as np
import pytest

from evidentia.functions import kernels
from evidentia.operators import filters
from pyspark.sql import functions as F

SHAPES = [(9, 9), (12, 31), (40, 17)]


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(4)
    return {k: rng.integers(0, 256, s).astype(np.uint8) for k, s in enumerate(SHAPES)} | {9: np.full((10, 10), 7, np.uint8)}


@pytest.fixture(scope="module")
def pixels(spark, pictures):
    rows = [(k, y, x, int(v)) for k, p in pictures.items() for y, line in enumerate(p) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "id long, y long, x long, v long").repartition(5)


def back(df, pictures, column="v"):
    out = {k: np.full(p.shape, -1.0) for k, p in pictures.items()}
    n = 0
    for r in df.select("id", "y", "x", column).collect():
        out[r["id"]][r["y"], r["x"]] = r[column]
        n += 1
    assert n == sum(p.size for p in pictures.values())
    return out


@pytest.mark.parametrize(("name", "kernel"), [("median", kernels.median), ("bilateral", kernels.bilateral), ("box", kernels.box), ("column_smooth", kernels.column_smooth)])
def test_filters_equal_the_kernels(pixels, pictures, name, kernel):
    got = back(getattr(filters, name)(pixels, ["id"]), pictures)
    for k, p in pictures.items():
        assert (got[k] == kernel(p)).all()


def test_gaussian_rounds_half_up(pixels, pictures):
    got = back(filters.gaussian(pixels, ["id"]), pictures)
    w = np.array(filters.BINOMIAL)
    for k, p in pictures.items():
        q = np.lib.stride_tricks.sliding_window_view(np.pad(p.astype(int), 2, "reflect"), (5, 5))
        assert (got[k] == (np.einsum("yxij,i,j->yx", q, w, w) + 128) // 256).all()
    twice = back(filters.column_smooth(pixels, ["id"], 2), pictures)
    assert all((twice[k] == kernels.column_smooth(p, 2)).all() for k, p in pictures.items())


def chance(k, y, x, seed):
    a, b, c, d = filters.FACTORS
    m = k * a + y * b + x * c + seed * d
    t = (m % filters.MODULUS) * (m % filters.MODULUS + seed) % filters.MODULUS
    return (t * 48_271 + m) % filters.MODULUS / filters.MODULUS


def loud(v, k, y, x, sigma, seed):
    return int(max(0, min(255, v + sigma * math.sqrt(-2 * math.log(1 - chance(k, y, x, seed))) * math.cos(2 * math.pi * chance(k, y, x, seed + 1)))))


def test_chance_is_even_and_noise_normal():
    u = np.array([chance(k, y, x, s) for k in range(8) for y in range(32) for x in range(32) for s in (0, 5)])
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.003 and np.histogram(u, 10, (0, 1))[0].std() < 0.05 * len(u) / 10
    z = np.array([loud(128, k, y, x, 25, 3) for k in range(4) for y in range(40) for x in range(40)])
    assert abs(z.mean() - 127.5) < 1.5 and abs(z.std() - 25) < 1.5


def test_damage(spark, pixels, pictures):
    zone = (F.col("y") >= 2) & (F.col("y") < 7) & (F.col("x") >= 3) & (F.col("x") < 8)
    noisy, hit = (back(filters.noise(pixels, "id", zone, 25, 3), pictures, c) for c in ("v", "hit"))
    salted = back(filters.salt_and_pepper(pixels, "id", zone, 2), pictures)
    both, marked = (back(filters.combined(pixels, "id", *[F.lit(n) for n in (12, 14, 12, 15)], seed=5), pictures, c) for c in ("v", "hit"))
    for k, p in pictures.items():
        for y, x in np.ndindex(p.shape):
            inside, v = 2 <= y < 7 and 3 <= x < 8, int(p[y, x])
            assert hit[k][y, x] == inside and noisy[k][y, x] == (loud(v, k, y, x, 25, 3) if inside else v)
            dice = chance(k, y, x, 2)
            assert salted[k][y, x] == ((0 if dice < 0.05 else 255 if dice > 0.95 else v) if inside else v)
            core, halo = 12 <= y < 14 and 12 <= x < 15, 2 <= y < 24 and 2 <= x < 25
            assert marked[k][y, x] == core and both[k][y, x] == (0 if core else loud(v, k, y, x, 12.0, 5) if halo else v)


@pytest.mark.parametrize("vertical", [False, True])
def test_bars(pixels, pictures, vertical):
    rows = filters.bars(pixels, "id", 3, 2, vertical, 255, 4)
    v, hit = back(rows, pictures), back(rows, pictures, "hit")
    for k, p in pictures.items():
        size = p.shape[1 if vertical else 0]
        at = [int(chance(k, 0, i, 4) * max(1, size - 2)) for i in range(3)]
        mask = np.zeros(p.shape, bool)
        for a in at:
            (mask.T if vertical else mask)[a : a + 2] = True
        assert (hit[k] == mask).all() and (v[k] == np.where(mask, 255, p)).all()


def test_imperfect_masks(pixels, pictures):
    mask = pixels.select("id", "y", "x", (F.col("v") > 240).cast("int").alias("hit"))
    got = back(filters.imperfect(mask, "id", 2, 1, 0.05, 6), pictures, "hit")
    for k, p in pictures.items():
        m = p > 240
        for change, n in ((kernels.dilate, 2), (kernels.erode, 1)):
            for _ in range(n):
                m = change(m, 5)
        want = np.array([[1 if (d := chance(k, y, x, 6)) < 0.05 else 0 if d > 0.95 else m[y, x] for x in range(p.shape[1])] for y in range(p.shape[0])])
        assert (got[k] == want).all()
