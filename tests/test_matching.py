"""Descriptor matching against brute force: nearest and mutual points, greedy groups, plans without nested loops."""

import random

import pytest

from evidentia.operators import matching
from evidentia.operators.settled import components

DDL = "image_id long, point_id long, code array<long>, y long, x long"


def bits_of(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))


def brute(rows):
    out = {}
    for i, p, c, *_ in rows:
        near = [(bits_of(c, d), q) for j, q, d, *_ in rows if j == i and q != p and d is not None] if c is not None else []
        if near:
            out[i, p] = min(near)
    return out


def made(seed, n, words, spread):
    rng = random.Random(seed)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    base = [[rng.getrandbits(64) for _ in range(words)] for _ in range(n // 4)]
    rows = []
    for p in range(n):
        code = [w for w in rng.choice(base)]
        for _ in range(rng.randrange(spread + 1)):
            code[rng.randrange(words)] ^= 1 << rng.randrange(64)
        rows.append((p % 3, p * 7 % n, [signed(w) for w in code], rng.randrange(200), rng.randrange(200)))
    return [*rows, (9, 1, [0] * words, 0, 0), (8, 1, None, 0, 0), (8, 2, [1] * words, 0, 0)]


@pytest.mark.parametrize(("words", "spread"), [(1, 3), (1, 40), (4, 30)])
def test_nearest_and_mutual_points_equal_brute_force(spark, words, spread):
    rows = made(words, 90, words, spread)
    df = spark.createDataFrame(rows, DDL)
    want = brute(rows)
    got = {(r["image_id"], r["point_id"]): (r["distance"], r["other_id"]) for r in matching.nearest(df, words).collect()}
    assert got == want
    pairs = {(r["image_id"], r["point_id"], r["other_id"]) for r in matching.mutual(df, words).collect()}
    assert pairs == {(i, p, q) for (i, p), (_, q) in want.items() if p < q and want[i, q][1] == p}
    most = 10 * words
    got = {(r["image_id"], r["point_id"]): (r["distance"], r["other_id"]) for r in matching.nearest(df, words, most).collect()}
    assert got == {k: v for k, v in want.items() if v[0] <= most}


@pytest.mark.parametrize(("most", "bits"), [(0, None), (7, None), (20, None), (16, 56), (64, None)])
def test_all_within_a_distance_equal_brute_force(spark, most, bits):
    cut = (1 << (bits or 64)) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(p, None if c is None else [signed(c[0] & cut)]) for p, c in enumerate(r[2] for r in made(most, 70, 1, 25))]
    df = spark.createDataFrame(rows, "point_id long, code array<long>")
    got = [tuple(r) for r in matching.within(df.where("point_id % 5 = 0"), df, 1, most, bits).collect()]
    want = [(p, q, bits_apart) for p, a in rows if p % 5 == 0 and a for q, b in rows if b and p != q and (bits_apart := bits_of(a, b)) <= most]
    assert sorted(got) == sorted(want)


def test_no_plan_compares_all_with_all(spark):
    df = spark.createDataFrame(made(5, 40, 1, 3), DDL)
    plan = matching.nearest(df, 1)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def greedy(places, reach=40):
    used, out = set(), {}
    for i, (y, x) in enumerate(places):
        if i in used:
            continue
        for j, (v, u) in enumerate(places):
            if j not in used and (j == i or (v - y) ** 2 + (u - x) ** 2 < reach**2):
                used.add(j)
                out[j] = i
    return out


@pytest.mark.parametrize("size", [60, 200, 600])
def test_leaders_equal_the_greedy_walk(spark, size):
    rng = random.Random(size)
    pictures = {k: [(rng.randrange(size), rng.randrange(size)) for _ in range(n)] for k, n in ((0, 50), (1, 1), (2, 120), (3, 2))}
    pictures[4] = [(0, 30 * i) for i in range(30)]  # a chain: each depends on the one before
    pictures[5] = [(7, 7)] * 9
    df = spark.createDataFrame([(k, i, y, x) for k, p in pictures.items() for i, (y, x) in enumerate(p)], "image_id long, place long, y long, x long")
    got = {(r["image_id"], r["place"]): r["leader"] for r in matching.leaders(df).collect()}
    assert got == {(k, j): i for k, p in pictures.items() for j, i in greedy(p).items()}


def test_all_matches_of_a_picture_are_grouped(spark):
    """Far more than fifty matches, many at one spot, in some rows' order only: boxes around the leaders of the greedy walk."""
    rng = random.Random(4)
    pictures = {1: [(rng.randrange(160), rng.randrange(240)) for _ in range(700)], 2: [(5, 5)] * 300 + [(90, 90 + i) for i in range(60)], 3: [(0, 0), (1, 1)], 4: [(-200 + 30 * i, 3) for i in range(61)]}
    rows = [(k, 7 * i + 3, y, x) for k, p in pictures.items() for i, (y, x) in enumerate(p)]
    rng.shuffle(rows)
    got = [tuple(r) for r in matching.groups(spark.createDataFrame(rows, "image_id long, point_id long, y long, x long").repartition(5)).select("image_id", "leader", "x", "y", "w", "h", "n_matches").collect()]
    want = []
    for k, p in pictures.items():
        of = {}
        for j, i in greedy(p).items():
            of.setdefault(i, []).append(p[j])
        for i, g in of.items():
            (y0, x0), (y1, x1) = (tuple(f(c) for c in zip(*g, strict=True)) for f in (min, max))
            want += [(k, i + 1, x0, y0, x1 - x0 + 20, y1 - y0 + 20, len(g))] if len(g) >= 3 else []
    assert sorted(got) == sorted(want) and sum(r[-1] for r in want if r[0] == 1) > 600


def test_places_without_a_spot_lead_themselves(spark):
    rows = [(1, 1, 5, 5), (1, 2, None, 5), (1, 3, 5, None), (1, 4, 6, 6), (2, 1, None, None)]
    got = {(r["image_id"], r["place"]): r["leader"] for r in matching.leaders(spark.createDataFrame(rows, "image_id long, place long, y long, x long")).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 4): 1, (2, 1): 1}


def test_strong_matches_and_verdicts(spark):
    pts = [(1, i, [i // 2 * 0x0F0F0F0F], 0, 100 * (i % 2) + i) for i in range(30)] + [(2, 1, [1], 0, 0), (2, 2, [1], 3, 4)]
    df = spark.createDataFrame(pts, DDL)
    found = matching.strong(matching.mutual(df, 1), df, 1)
    assert {(r["image_id"], r["point_id"], r["other_id"]) for r in found.collect()} == {(1, 2 * i, 2 * i + 1) for i in range(15)}
    got = {r["image_id"]: tuple(r)[1:] for r in matching.verdicts(df, found).collect()}
    assert got == {1: (30, 15, True, 0.3), 2: (2, 0, False, 0.0)}
    assert {(r["x"], r["y"], r["w"], r["h"], r["n_matches"]) for r in matching.groups(found).collect()} == {(0, 0, 48, 20, 15)}
    empty = df.where("false")
    assert matching.mutual(empty, 1).count() == 0 and matching.leaders(spark.createDataFrame([], "image_id long, place long, y long, x long")).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
