"""Tiles of pairs: each pair once, and results that grow with the rows, not with the pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import clustering, matching, tiles
from evidentia.plans import registry


@pytest.mark.parametrize("n", [1, 4])
def test_every_pair_meets_in_one_tile(spark, n):
    rows = tiles.triangle(spark.range(60), F.col("id"), n).collect()
    met = []
    for tile in {r["tile"] for r in rows}:
        here = [r for r in rows if r["tile"] == tile]
        one, two = ([r["id"] for r in here if r["second"] == side] for side in (False, True))
        met += [(min(a, b), max(a, b)) for a in one for b in (one if here[0]["same"] else two) if not here[0]["same"] or a < b]
    assert len(met) == len(set(met)) == 60 * 59 // 2


def test_a_dense_group_makes_links_by_rows_not_by_pairs(spark):
    rng = np.random.default_rng(1)
    u = 1 + 0.01 * rng.standard_normal((3000, 16))
    u /= np.linalg.norm(u, axis=1)[:, None]
    df = spark.createDataFrame([(i, list(map(float, x)), True) for i, x in enumerate(u)], "id long, u array<double>, core boolean")
    rows = clustering.links(tiles.triangle(df, F.col("id"), 2), 0.3, 16).collect()
    assert len(rows) < 3 * len(u) and all(r["linked"] for r in rows)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = {i: list(map(float, rng.standard_normal(6))) for i in range(300)} | {400: [0.0] * 6, 401: None, 402: [1.0, None, 0.5], 403: [], 404: [2.0, None, 1.0, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>").repartition(5)
    full = {i: np.array([x or 0.0 for x in v] + [0.0] * (6 - len(v))) for i, v in vectors.items() if v}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in full.items()}
    want = {}
    for i in unit:
        if i % 2 == 0:
            apart = sorted((round(1 - float(unit[i] @ unit[j]), 9), j) for j in unit if j != i)
            want[i] = (sum(d <= 0.4 for d, _ in apart), *apart[0])
    found = clustering.looked_up(df.where("id % 2 = 0"), df, 0.4)
    plan = found._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and "Generate posexplode" not in plan  # vectors meet whole, not a row a number
    got = {r["id"]: (r["near"], r["distance"] + 0.0, r["other"]) for r in found.collect()}
    assert got == want
    assert clustering.looked_up(df.where("false"), df, 0.4).count() == clustering.looked_up(df, df.where("false"), 0.4).count() == 0


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    checks = duckdb.connect()
    checks.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return lambda name: (sorted(tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()), sorted(checks.execute(registry.ORACLES[name]).fetchall()))


def test_fragments_of_two_characters_are_compared_whole(spark, tmp_path):
    got, want = documents(spark, tmp_path, ["abababab", "ababababx", "aaaa", "abcabcabcabc", "abcdabcdabcdabcd"])("fragment_continuity_pairs")
    assert got == want and (0, 0, 1, 1.0) in got


def test_windows_are_compared_in_their_row(spark, tmp_path):
    texts = ["abcdefgh" * 9 + "\n" * 30, "é😀\r\nabcd" * 200, None, "", "abcdefg", "x" * 64, "".join(chr(40 + i * i % 77) for i in range(5000))]
    got, want = documents(spark, tmp_path, texts)("window_hash_overlap")
    assert got == want and got
    assert "Exchange" not in registry.QUERIES["window_hash_overlap"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_shares_are_rounded_as_doubles(spark, tmp_path):
    word = lambda k: f"{k:08d}"
    text = "".join(map(word, range(640))) + "".join(map(word, range(1000, 1640))) + "".join(map(word, range(2000, 2640))) + "".join(map(word, [*range(41), *range(3000, 3599)]))
    got, want = documents(spark, tmp_path, [text])("window_hash_overlap")
    assert got == want == [(0, 0, 3, 0.064062)]


def test_points_of_several_blocks_equal_brute_force_and_move_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 40)
    rng = np.random.default_rng(3)
    codes = {(k, i): int(x) for k, n in ((1, 130), (2, 1), (3, 40)) for i, x in enumerate(rng.integers(0, 1 << 14, n))}
    df = spark.createDataFrame([(k, i, [c]) for (k, i), c in codes.items()], "image_id long, point_id long, code array<long>")
    want = {(k, i): min(((c ^ d).bit_count(), j) for (m, j), d in codes.items() if m == k and j != i) for (k, i), c in codes.items() if k != 2}
    found = matching.nearest(df, 1)
    assert {(r["image_id"], r["point_id"]): (r["distance"], r["other_id"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "Generate explode(sequence" in plan and "flip" not in plan  # a row a block, not a row a flipped bit
