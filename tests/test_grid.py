"""Stencils, morphology and components on pixel relations against NumPy loops, at sizes that fit no block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import grid

SHAPES = [(1, 1), (1, 9), (7, 1), (5, 6), (13, 40), (33, 17)]


def relation(spark, pictures):
    rows = [(k, y, x, int(v)) for k, p in pictures.items() for y, line in enumerate(p) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "id long, y long, x long, v long").repartition(5)


def back(df, pictures, column):
    out = {k: np.full(p.shape, np.nan) for k, p in pictures.items()}
    for r in df.select("id", "y", "x", column).collect():
        out[r["id"]][r["y"], r["x"]] = r[column]
    return out


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(0)
    return {k: rng.integers(0, 256, s) for k, s in enumerate(SHAPES)} | {50: np.full((12, 12), 127)}


@pytest.mark.parametrize("window", [3, 9, 11])
def test_variance(spark, pictures, window):
    got = back(grid.local_variance(relation(spark, pictures), ["id"], window), pictures, "variance")
    for k, p in pictures.items():
        q = np.pad(p.astype(float), window // 2, "reflect")
        want = np.array([[q[y : y + window, x : x + window].var() for x in range(p.shape[1])] for y in range(p.shape[0])])
        assert np.allclose(got[k], want)


def test_slopes(spark, pictures):
    df = grid.slopes(relation(spark, pictures), ["id"])
    gx, gy, lap = (back(df, pictures, c) for c in ("gx", "gy", "lap"))
    for k, p in pictures.items():
        q = np.pad(p, 1, "reflect")
        at = lambda dy, dx, q=q, p=p: q[1 + dy : 1 + dy + p.shape[0], 1 + dx : 1 + dx + p.shape[1]]
        assert (gx[k] == sum(w * (at(d, 1) - at(d, -1)) for d, w in ((-1, 1), (0, 2), (1, 1)))).all()
        assert (gy[k] == sum(w * (at(1, d) - at(-1, d)) for d, w in ((-1, 1), (0, 2), (1, 1)))).all()
        assert (lap[k] == at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * p).all()


def morph(p, reach, pick):
    return np.array([[pick(p[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]) for x in range(p.shape[1])] for y in range(p.shape[0])])


def test_morphology(spark, pictures):
    masks = {k: (p > 90).astype(int) for k, p in pictures.items()}
    df = relation(spark, masks)
    opened, closed = back(grid.opened(df, ["id"], "v"), masks, "v"), back(grid.closed(df, ["id"], "v", 5, 2), masks, "v")
    for k, p in masks.items():
        assert (opened[k] == morph(morph(p, 2, np.min), 2, np.max)).all()
        twice = morph(morph(morph(morph(p, 2, np.max), 2, np.max), 2, np.min), 2, np.min)
        assert (closed[k] == twice).all()


def parts(mask):
    """(first pixel, area, box) of each part connected over sides and corners."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, set()
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        for y, x in todo:
            new = [(y + i, x + k) for i in (-1, 0, 1) for k in (-1, 0, 1) if (y + i, x + k) in left]
            left.difference_update(new)
            todo += new
        ys, xs = zip(*todo, strict=True)
        out.add((*min(todo), len(todo), min(ys), max(ys), min(xs), max(xs)))
    return out


def test_components(spark):
    rng = np.random.default_rng(3)
    masks = {k: (rng.random(s) < d).astype(int) for k, (s, d) in enumerate([((20, 70), 0.25), ((40, 90), 0.45), ((1, 100), 0.5), ((64, 3), 0.6), ((9, 9), 1.0), ((9, 9), 0.0), ((50, 200), 0.02)])}
    spiral = np.zeros((15, 15), int)
    spiral[0, :], spiral[:, 14], spiral[14, :], spiral[2:, 0], spiral[2, :12], spiral[2:12, 12] = 1, 1, 1, 1, 1, 1
    masks |= {90: spiral, 91: np.indices((10, 80)).sum(0) % 2}
    mask = relation(spark, masks).where("v = 1")
    got = {}
    for r in grid.component_table(mask.union(mask), ["id"]).collect():
        got.setdefault(r["id"], set()).add(tuple(r)[1:])
    assert got == {k: parts(p) for k, p in masks.items() if p.any()}
    kept = back(grid.large_parts(relation(spark, masks), ["id"], "v", F.lit(4), F.col("height") * F.col("width") / 2), masks, "v")
    for k, p in masks.items():
        assert kept[k].sum() == sum(a for _, _, a, *_ in parts(p) if 4 <= a <= p.size / 2)
    assert grid.component_table(mask.where("false"), ["id"]).count() == 0


def test_damage_and_fusion_of_a_large_picture(spark):
    rng = np.random.default_rng(5)
    p = rng.integers(70, 200, (60, 80))
    p[10:30, 20:50] = 0
    p[40:42, 66:68] = 0  # a speck
    p[40:54, 5:25] = 255
    hit = back(grid.damaged(relation(spark, {1: p}), ["id"]), {1: p}, "hit")[1]
    want = np.zeros_like(p)
    want[10:30, 20:50], want[40:54, 5:25] = 1, 1
    assert (hit == want).all()
    df = relation(spark, {1: p}).select("id", "y", "x", (F.col("v") < 22).cast("int").alias("a"), ((F.col("y") >= 10) & (F.col("y") < 30)).cast("int").alias("b"), F.lit(0).alias("c"))
    mask = grid.fused(df, ["id"], ["a", "b", "c"])
    wide = np.zeros_like(p)
    wide[8:32, 18:52] = 1
    assert (back(mask, {1: p}, "hit")[1] == wide).all()
    (score,) = grid.fusion_scores(mask, ["id"]).collect()
    assert score["agreement"] == 600 / 4800 and score["area_ratio"] == wide.mean() and score["confidence"] == pytest.approx(0.6 * 0.125 + 0.4 * 0.7)
    assert grid.fused(df, ["id"], ["a", "b", "c"], most_share=0.1).where("hit = 1").count() == 0


def areas(p, h, w):
    """Means over equal areas, from sums of whole parts, rounded half to even."""
    part = lambda n, m: np.array([[max(0, min((k + 1) * m, (i + 1) * n) - max(k * m, i * n)) for k in range(n)] for i in range(m)])
    return np.rint(part(p.shape[0], h) @ p @ part(p.shape[1], w).T / p.size)


def test_hashes_of_pictures_of_any_size(spark):
    rng = np.random.default_rng(8)
    pictures = {k: rng.integers(0, 256, s) for k, s in enumerate([(8, 8), (32, 32), (50, 41), (9, 70), (3, 5)])} | {7: np.full((20, 20), 9), 8: np.add.outer(np.arange(40), np.arange(36))}
    df = relation(spark, pictures)
    small = {k: areas(p, 8, 9) for k, p in pictures.items()}
    assert all((v == small[k]).all() for k, v in back(grid.resized(df, ["id"], 8, 9), small, "v").items())
    hexed = lambda bits: format(int("".join("01"[int(b)] for b in bits.ravel()), 2), "016x")
    got = {r["id"]: r["dhash"] for r in grid.difference_hash(df, ["id"]).collect()}
    assert got == {k: hexed(s[:, :-1] > s[:, 1:]) for k, s in small.items()}
    basis = np.cos(np.pi * (2 * np.arange(32) + 1)[None] * np.arange(8)[:, None] / 64) * np.sqrt(np.r_[1, [2] * 7] / 32)[:, None]
    low = {k: np.round(basis @ areas(p, 32, 32) @ basis.T, 6) for k, p in pictures.items()}
    got = {r["id"]: r["phash"] for r in grid.frequency_hash(df, ["id"]).collect()}
    assert got == {k: hexed(f > np.round((f.sum() - f[0, 0]) / 63, 6)) for k, f in low.items()}


def test_detection_makes_its_pictures_once(spark, monkeypatch):
    """All three measures read the pixels from where they are settled."""
    from evidentia.plans import evidence

    plans, variance = [], grid.local_variance
    monkeypatch.setattr(grid, "local_variance", lambda pixels, keys: plans.append(pixels._jdf.queryExecution().optimizedPlan().toString()) or variance(pixels, keys))
    monkeypatch.setattr(grid, "fused", lambda *a, **b: (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        evidence.detect_advanced(spark, "/root/testdata/sf0.001")
    assert plans and all("LogicalRDD" in p and "Join" not in p and "Relation" not in p for p in plans)
