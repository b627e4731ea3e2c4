"""Assembly of any number of fragments: order, gaps, rejected pieces, running digests, reports of dumps without any."""

import hashlib
import random

from evidentia.operators import fragments
from evidentia.sources import tables

DDL = "dump_id long, idx long, off long, data binary"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_reports_equal_a_plain_walk(spark):
    rng = random.Random(2)
    rows, dumps = [], {d: rng.randbytes(rng.randrange(50, 3000)) for d in range(12)} | {50: b"", 51: None}
    for d, body in dumps.items():
        at = 0
        for idx in range(rng.randrange(1, 40) if body else 0):
            at += rng.choice([0, 0, 5])
            n = rng.choice([0, 3, 7, 8, 9, 60])
            rows.append((d, idx, at, body[at : at + n]))
            at += n
        if body:
            rows += [(d, 90, at + 1, rows[-1][3] + b"12345678"), (d, 91, at + 2, rows[-1][3] + b"12345678"), (d, 92, at, None)]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    found = fragments.judged(df)
    chain = found.where("reason is null").selectExpr("*", "row_number() OVER (PARTITION BY dump_id ORDER BY off, idx) AS place", "CASE WHEN off > 0 THEN 0.5D END AS continuity")
    source = spark.createDataFrame(list(dumps.items()), "dump_id long, content binary")
    got = {r["dump_id"]: r for r in fragments.report(found, chain, source).collect()}
    files = {r["dump_id"]: bytes(r["data"]) for r in fragments.assembled(chain).collect()}
    assert set(got) == set(dumps)
    for d, body in dumps.items():
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1]))
        seen, used, gone = set(), [], []
        for r in own:
            data = r[3] or b""
            reason = "too_small" if len(data) < 8 else "duplicate" if sha(data) in seen else None
            seen.add(sha(data))
            (gone if reason else used).append((r[2], r[1], data, reason))
        running, gaps, end = "", 0, None
        for off, _, data, _ in used:
            running = sha((running + sha(data)).encode())
            gaps += max(0, off - end) if end is not None else 0
            end = off + len(data)
        whole = b"".join(u[2] for u in used)
        r = got[d]
        assert r["sha256_dump"] == sha(body or b"") and (r["total_fragments"], r["used_fragments"], r["rejected_fragments"]) == (len(own), len(used), len(gone))
        assert r["assembly"].asDict() == {"size": len(whole), "sha256": sha(whole), "gaps": gaps, "running": running}
        assert files.get(d, b"") == whole
        assert [(x["off"], x["idx"], x["reason"]) for x in r["fragments_rejected"]] == [(g[0], g[1], g[3]) for g in gone]
        assert [(x["off"], x["idx"], x["size"]) for x in r["fragments_used"]] == [(u[0], u[1], len(u[2])) for u in used]
        score = [0.5 if u[0] > 0 else 1.0 for u in used]
        assert abs(r["assembly_score"] - (sum(score) / len(score) if score else 0.0)) < 1e-12


def test_scattered_dumps_hold_what_their_truth_says(spark):
    rng = random.Random(9)
    dumps = {d: rng.randbytes(n) for d, n in enumerate([0, 1, 2, 5, 6, 7, 100, 5000])} | {20: None}
    df = spark.createDataFrame(list(dumps.items()), "dump_id long, content binary").repartition(3)
    truth = fragments.scattered(df, 6, 0.3, 40, 7)
    rows = truth.collect()
    new = {r["dump_id"]: bytes(r["content"]) for r in fragments.dumped(truth, 40).collect()}
    for d, body in dumps.items():
        own = sorted((r for r in rows if r["dump_id"] == d), key=lambda r: r["idx"])
        assert len(own) == 6 and b"".join(bytes(r["data"]) for r in own) == (body or b"")
        assert [r["source_offset"] for r in own] == [sum(x["size"] for x in own[:k]) for k in range(6)]
        kept = sorted((r for r in own if not r["lost"]), key=lambda r: r["place"])
        assert [r["place"] for r in kept] == list(range(1, len(kept) + 1)) and all(r["place"] is None for r in own if r["lost"])
        assert all(new[d][r["dump_offset"] : r["dump_offset"] + r["size"]] == bytes(r["data"]) for r in kept)
        assert not kept or len(new[d]) == sum(r["size"] + 40 for r in kept)
    assert any(r["lost"] for r in rows) and sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in truth.collect())


def test_fragment_files_go_by_name_in_each_directory(spark, tmp_path):
    for name, body in (("a/2.bin", b"two"), ("a/10.bin", b"ten"), ("b/x.bin", b""), ("b/y.txt", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {(r["path"].rsplit("/", 2)[1] + "/" + r["path"].rsplit("/", 1)[1]): (r["idx"], r["off"], r["size"], bytes(r["data"])) for r in tables.fragment_files(spark, str(tmp_path), "*.bin").collect()}
    assert got == {"a/10.bin": (1, 0, 3, b"ten"), "a/2.bin": (2, 1, 3, b"two")}
