"""Features against NumPy, neighbours and density clusters against brute force."""

import numpy as np
import pytest

from evidentia.operators import clustering


def features_of(img):
    """107 numbers of an array [y, x, bgr]."""
    out = []
    for c in range(3):
        h = np.bincount(img[:, :, c].ravel() // 8, minlength=32)
        out += list(h / (h.sum() + 1e-9))
    for c in range(3):
        x = img[:, :, c].astype(float)
        out += [x.mean() / 255, x.std() / 255, np.clip((((x - x.mean()) / (x.std() + 1e-9)) ** 3).mean() / 10, -1, 1)]
    b, g, r = (img[:, :, c].astype(np.int64) for c in range(3))
    gray = (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14
    n = max(8, min(gray.shape) // 8)
    found = []
    for y in range(0, gray.shape[0] - n, n):
        for x in range(0, gray.shape[1] - n, n):
            p = np.bincount(gray[y : y + n, x : x + n].ravel() // 16, minlength=16) / (n * n + 1e-9)
            found.append(-(p * np.log2(p + 1e-9)).sum())
    return np.array([*out, np.mean(found) / 4 if found else 0.0, gray.var() / 255**2])


def test_features_of_pictures(spark):
    rng = np.random.default_rng(0)
    pictures = {k: rng.integers(0, 256, (*s, 3)) for k, s in enumerate([(8, 8), (16, 16), (17, 30), (80, 70), (1, 3)])} | {9: np.full((20, 20, 3), 77)}
    rows = [(k, y, x, *map(int, p[y, x])) for k, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    got = {r["id"]: r["features"] for r in clustering.features(spark.createDataFrame(rows, "id long, y long, x long, b long, g long, r long").repartition(4), ["id"]).collect()}
    for k, p in pictures.items():
        assert len(got[k]) == 107 and np.allclose(got[k], features_of(p), atol=1e-9)


def labels_of(vectors, eps, least):
    u = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in vectors if v is not None}
    near = {i: [j for j in u if j != i and 1 - float(u[i] @ u[j]) <= eps + 1e-12] for i in u}
    core = {i for i in u if len(near[i]) + 1 >= least}
    out, name = {i: -1 for i, _ in vectors}, {}
    for i in sorted(core):
        if i not in name:
            todo = [i]
            for j in todo:
                name[j] = i
                todo += [k for k in near[j] if k in core and k not in name and k not in todo]
    for i in u:
        out[i] = name.get(i, min((name[j] for j in near[i] if j in core), default=-1))
    return out


@pytest.mark.parametrize(("least", "width"), [(2, 5), (4, 5), (3, 2), (2, 1)])
def test_clusters_equal_brute_force(spark, least, width):
    rng = np.random.default_rng(least)
    centres = rng.standard_normal((7, width))
    vectors = [(i, list(map(float, centres[i % 7] + 0.25 * rng.standard_normal(width)))) for i in range(120)]
    vectors += [(200 + i, vectors[3][1]) for i in range(5)] + [(300, [0.0] * width), (301, None), (302, list(map(float, rng.standard_normal(width))))]
    df = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(5)
    for eps in (0.02, 0.1):
        got = {r["id"]: r["cluster"] for r in clustering.clusters(df, eps, least).collect()}
        assert got == labels_of(vectors, eps, least)
    rows = clustering.rollup(clustering.clusters(df, 0.1, least)).collect()
    assert sum(r["size"] for r in rows) == len(vectors) and {r["coherence"] for r in rows} == {round(sum(v != -1 for v in got.values()) / len(got), 3)}


def test_nothing_to_cluster(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    assert clustering.clusters(empty).count() == 0 and clustering.rollup(clustering.clusters(empty)).count() == 0
    assert [tuple(r) for r in clustering.clusters(spark.createDataFrame([(1, None)], "id long, vector array<double>")).collect()] == [(1, -1)]
