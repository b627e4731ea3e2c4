"""Rules and scores of picture evidence against checks written apart, hand-made cases and known invariants."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import kernels, regional
from evidentia.operators import grid, repair
from evidentia.plans import evidence, forensics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings", "pages", "documents", "supplier", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(forensics.QUERIES))
def test_query_equals_its_check(spark, duck, name):
    df = forensics.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(forensics.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and got == want and got


def damaged(n=128):
    y, x = np.mgrid[:n, :n]
    img = np.stack([y * 256 // n, x * 256 // n, 200 - y * 128 // n], -1).astype(np.uint8)
    mask = np.zeros((n, n), bool)
    mask[n // 3 : n // 2, n // 3 : n // 2] = True
    bad = img.copy()
    bad[mask] = 0
    return img, bad, mask


def test_plans_have_the_baseline_and_all_strategies_in_order():
    assert [len(repair.strategies(r)) for r in ("inpainting", "hybrid", "denoise", "deblur", "block_repair")] == [20, 20, 19, 19, 19]
    assert [len(repair.strategies(r, exhaustive=True)) for r in ("inpainting", "denoise")] == [24, 23]
    assert [s[0] for s in repair.strategies("inpainting")][:4] == ["conservative", "inpainting_r3", "inpainting_r5", "inpainting_r7"]
    assert repair.strategies("denoise", exhaustive=True)[-1][0] == "meta_regional"


def test_every_strategy_mends_a_picture():
    img, bad, mask = damaged(48)
    for name, family, fix in repair.strategies("hybrid", exhaustive=True):
        out = fix(bad, mask)
        assert out.shape == bad.shape and out.dtype == np.uint8
        if family in ("inpainting", "criminisi", "patchmatch"):
            assert np.array_equal(out[~mask], bad[~mask])
            assert np.abs(out.astype(int) - img)[mask].mean() < 40, name


def test_blind_score_splits_the_change_at_the_mask():
    img, bad, mask = damaged(64)
    mended = kernels.inpaint(bad, mask)
    outside = mended.copy()
    outside[~mask] = 255 - outside[~mask]
    assert repair.blind_score(bad, mended, mask) > repair.blind_score(bad, outside, mask)
    assert repair.blind_score(bad, bad, mask) < repair.blind_score(bad, bad)  # no work done in the mask: effort 0.45 against 1


def test_region_areas_make_up_the_mask():
    _, bad, mask = damaged(72)
    rng = np.random.default_rng(7)
    bad[:, 36:] = rng.integers(0, 256, (72, 36, 3))
    parts = regional.segments(bad, mask)
    assert 2 <= len(parts) <= 6 and sum(int(p.sum()) for _, p in parts) == mask.sum()
    assert np.logical_or.reduce([p for _, p in parts]).sum() == mask.sum()
    out, score, report = regional.meta_regional(bad, mask)
    assert out.shape == bad.shape and score == pytest.approx(sum(a * s for *_, a, s in report) / mask.sum())
    assert regional.segments(bad, np.zeros_like(mask)) == []


def test_a_failing_strategy_stops_no_other(spark, monkeypatch):
    def broken(i, m):
        raise ValueError("no")

    monkeypatch.setattr(repair, "strategies", lambda *a: [("conservative", "conservative", lambda i, m: i), ("bad", "x", broken), ("deblur_light", "deblur", lambda i, m: kernels.column_smooth(i))])
    _, bad, mask = damaged(16)
    row = type("Row", (), {})
    frame = spark.createDataFrame([("a", "k", 16, 16, 3, bytes(bad.tobytes()), bytes(bad.tobytes()), bytes(mask.tobytes()))], "image_id string, kind string, height int, width int, n_channels int, original binary, data binary, mask binary")
    got = {}

    def take(pictures, f, schema):
        record = frame.first()
        for k in frame.columns:
            setattr(row, k, record[k])
        row._replace = lambda **kw: type("Row", (), {**{k: record[k] for k in frame.columns}, **kw})
        got["rows"] = list(f(row))

    monkeypatch.setattr(repair, "each", take)
    repair.repair(frame)
    by = {r[3]: r for r in got["rows"]}
    assert by["bad"][5] is None and by["bad"][9] == "no" and by["conservative"][5] is not None and by["deblur_light"][5] is not None


def test_ssim_of_a_relation_equals_the_kernel(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (2, 12, 10))
    rows = [(1, y, x, int(a[y, x]), int(b[y, x])) for y in range(12) for x in range(10)]
    got = forensics.ssim(spark.createDataFrame(rows, "id long, y long, x long, a long, w long"), ["id"], "a", "w").first()["ssim"]
    assert got == pytest.approx(kernels.ssim(a.astype(np.uint8), b.astype(np.uint8)), abs=1e-9)


def test_copied_square_is_found(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (40, 40))
    img[25:33, 25:33] = img[3:11, 3:11]
    rows = [("p", y, x, int(img[y, x])) for y in range(40) for x in range(40)]
    got = forensics.copied_blocks(spark.createDataFrame(rows, "image_id string, y int, x int, v int"), 8, 10.0).collect()
    assert [(r["y"], r["x"], r["from_y"], r["from_x"]) for r in got] == [(25, 25, 3, 3)]


def test_throttle_by_hand(spark):
    rows = [("t", float(s), i, "strategy_running") for i, s in enumerate((0, 5, 29, 30, 59, 60))] + [("u", 1.0, 9, "task_started"), ("u", 20.0, 10, "strategy_running"), ("u", 31.0, 11, "strategy_running")]
    got = forensics.throttled(spark.createDataFrame(rows, "task string, seconds double, seq int, phase string")).collect()
    assert sorted(r["seq"] for r in got) == [3, 5, 9, 11]


def test_header_verdicts(spark):
    png = kernels.png(np.zeros((3, 4, 3), np.uint8))
    rows = spark.createDataFrame([("png", bytearray(png)), ("cut", bytearray(png[:20])), ("jpeg", bytearray(b"\xff\xd8\xff\xe0abc")), ("none", bytearray(b"")), ("null", None)], "id string, content binary")
    got = {r["id"]: r["v"] for r in rows.select("id", forensics.header_verdict(F.col("content"), ("PNG",)).alias("v")).collect()}
    assert (got["png"]["valid"], got["png"]["width"], got["png"]["height"]) == (True, 4, 3)
    assert [got[k]["reason"] for k in ("cut", "jpeg", "none", "null")] == ["unreadable", "format", "unreadable", "unreadable"]


def test_pieces_are_cut_once_and_not_once_an_order(spark):
    plan = forensics.fragment_permutations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(") == 4 and "lambda" not in plan and "sha2" not in plan


def test_scored_pictures_are_moved_whole_and_once(spark):
    """What a task sorts is bounded by the pictures dealt to it; pixels were shuffled and joined before, in as many parts at any size."""
    df = forensics.supervised_score(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(vec_id") == plan.count("Exchange ") == 1 and "Join" not in plan
    assert plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning(vec_id")


@pytest.mark.parametrize("name", ["benchmark_modes", "report_json", "legal_json"])
def test_what_is_made_of_scores_moves_no_pixel(spark, monkeypatch, name):
    """With nothing settled between, no step down to the table is dealt by a picture's row, column or strategy."""
    monkeypatch.setattr(grid, "settled", lambda df: df)
    plan = evidence.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and not re.search(r"Exchange hashpartitioning\(vec_id#\d+L?, [a-z]", plan)


@pytest.mark.parametrize("name", ["report_json", "legal_json"])
def test_scores_are_dealt_to_reports_by_their_number(spark, monkeypatch, name):
    """Behind the scores a task's rows are bounded, too: what is dealt out once serves every window, group and join of the report."""
    monkeypatch.setattr(forensics, "scored", lambda *a: spark.sql("SELECT id AS vec_id, 'a' AS strategy, 1D AS score, 2D AS psnr, 3D AS ssim, 4D AS gain_psnr, 5D AS gain_ssim FROM range(100)"))
    monkeypatch.setattr(grid, "PART", 4)
    df = evidence.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert re.search(r"hashpartitioning\(run_key#\d+, 25\), REPARTITION_BY_NUM", plan) and "ENSURE_REQUIREMENTS" not in plan
    assert df.rdd.getNumPartitions() == 25 and df.count() == df.select("run_key").distinct().count() == 100


def test_parts_follow_the_rows(spark):
    few, many = (grid.dealt(spark.range(n), ["id"], 100) for n in (5, 2_000))
    assert few.rdd.getNumPartitions() == 8 and many.rdd.getNumPartitions() == 20 and many.distinct().count() == 2_000


def test_repairs_side_by_side_equal_the_kernel_one_by_one(spark):
    """Pictures whose zone is smaller than they are, without a mask, and too small for a window."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for k, (h, w, box) in enumerate([(40, 36, (20, 24, 15, 17)), (30, 30, (0, 3, 28, 30)), (12, 9, None), (5, 9, (1, 2, 3, 4)), (7, 30, (2, 3, 0, 1))]):
        o = rng.integers(0, 256, (h, w))
        mask = np.zeros((h, w), bool)
        if box:
            mask[box[0] : box[1], box[2] : box[3]] = True
        d = np.where(mask, 0, o)
        tried = {"nothing": d, "guess": np.where(mask, np.clip(o + rng.integers(-40, 41, o.shape), 0, 255), o)}
        rows += [(k, y, x, int(o[y, x]), int(d[y, x]), bool(mask[y, x]), *[int(a[y, x]) for a in tried.values()]) for y in range(h) for x in range(w)]
        if min(h, w) >= 7:
            want |= {(k, n): repair.supervised_score(*[i.astype(np.uint8) for i in (o, d, a)], mask) for n, a in tried.items()}
    pixels = spark.createDataFrame(rows, "id long, y long, x long, o long, d long, hit boolean, nothing long, guess long")
    got = {(r["id"], r["strategy"]): r for r in forensics.supervised(pixels, ["id"], nothing="nothing", guess="guess").collect()}
    assert len(got) == 10
    for key, (score, psnr, ssim) in want.items():
        assert (got[key]["score"], got[key]["psnr"], got[key]["ssim"]) == pytest.approx((score, psnr, ssim), abs=1e-7)
    assert got[2, "guess"]["zone_ssim"] is None and got[3, "guess"]["ssim"] is None and 0 < got[3, "guess"]["zone_ssim"] < 1
    alone = {r["id"]: r for r in forensics.supervised(pixels.withColumn("w", F.col("guess")), ["id"]).collect()}
    for k in range(5):
        same = got[k, "guess"].asDict()
        assert same.pop("strategy") == "guess" and alone[k].asDict() == pytest.approx(same, nan_ok=True)
