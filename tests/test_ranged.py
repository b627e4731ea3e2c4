"""Ranged carving: pairs across ranges against a plain search and against whole dumps, and a dump of over two gigabytes."""

import bisect
import hashlib
import random

import pytest

from evidentia.operators import carve, ranged
from evidentia.sources import tables

MARKS = "dump_id string, offset long"


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
@pytest.mark.parametrize("gap", [0, 2, 9])
def test_pairs_equal_a_plain_search(spark, size, gap):
    rng = random.Random(size)
    starts = {d: sorted(rng.sample(range(900), rng.randrange(1, 60))) for d in "abc"} | {"lone": [5, 6], "none": []}
    stops = {d: sorted(rng.sample(range(900), rng.randrange(1, 25))) for d in "abc"} | {"lone": [], "none": [3]}
    want = set()
    for d, at in starts.items():
        pairs = [(s, stops[d][k]) for s in at if (k := bisect.bisect_left(stops[d], s + gap)) < len(stops[d])]
        want |= {(d, i, s, e + 2, e + 2 - s) for i, (s, e) in enumerate(pairs, 1)}
    df = lambda marks: spark.createDataFrame([(d, x) for d, at in marks.items() for x in at] + [(None, 1), ("a", None)], MARKS)
    assert {tuple(r) for r in ranged.paired(df(starts).union(df(starts)), df(stops), gap, 2, size).collect()} == want


def noise(rng, n):
    return bytes(rng.choices(range(1, 0xD0), k=n))


def jpeg(rng, n):
    return carve.JPEG_START + b"\xff\xe0" + noise(rng, n) + carve.JPEG_END


def png(rng, n):
    return carve.PNG_START + noise(rng, n) + carve.PNG_END


@pytest.mark.parametrize("size", [100, 1000, 1 << 20])
def test_segments_equal_those_of_whole_dumps(spark, tmp_path, size):
    rng = random.Random(size)
    for k in range(3):
        parts = [f(rng, rng.randrange(50, 900)) + noise(rng, rng.randrange(300)) for f in rng.choices([jpeg, png, noise], k=20)]
        (tmp_path / f"dump {k}.bin").write_bytes(b"".join(parts) + carve.JPEG_START + noise(rng, 50))
    (tmp_path / "empty.bin").write_bytes(b"")
    columns = ["dump_id", "index", "start_offset", "end_offset_exclusive", "size", "format"]
    whole = tables.dumps(spark, str(tmp_path))
    want = {tuple(r) for r in carve.segments(whole, ("jpeg", "png")).select(*columns).collect()}
    found = ranged.segments(spark, str(tmp_path), size=size).select(*columns)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 20
    bodies = {r["dump_id"]: bytes(r["content"]) for r in whole.collect()}
    for r in ranged.extracted(found, size).collect():
        body = bodies[r["dump_id"]][r["start_offset"] : r["end_offset_exclusive"]]
        assert bytes(r["data"]) == body and r["sha256"] == hashlib.sha256(body).hexdigest()


def test_a_dump_of_over_two_gigabytes(spark, tmp_path):
    """Sparse, so that it takes no disk: a picture in each of its quarters, one across a range's end, one from end to end."""
    rng = random.Random(1)
    path, pictures = tmp_path / "large.bin", {}
    with path.open("wb") as f:
        for k in range(4):
            at = k * (600 << 20) + (ranged.RANGE - 300 if k == 1 else 12_345)
            pictures[at] = jpeg(rng, 5000)
            f.seek(at)
            f.write(pictures[at])
        f.seek(1000)
        f.write(carve.PNG_START)
        f.seek((2300 << 20) + 17)
        f.write(carve.PNG_END)
    assert path.stat().st_size > 2 << 30
    found = ranged.segments(spark, str(path))
    rows = {(r["format"], r["start_offset"], r["size"]) for r in found.collect()}
    assert rows == {("jpeg", at, len(b)) for at, b in pictures.items()} | {("png", 1000, (2300 << 20) + 17 + len(carve.PNG_END) - 1000)}
    cut = {r["start_offset"]: r["data"] for r in ranged.extracted(found).collect()}
    assert cut.pop(1000) is None and {k: bytes(v) for k, v in cut.items()} == pictures


def test_windows_go_by_range(spark):
    df = spark.createDataFrame([("a", 1)], MARKS)
    plan = ranged.paired(df, df, 0, 1)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
