"""Line deduplication against a brute force: runs across partitions and pieces, repeated and null ids, awkward texts, the bitmaps."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from evidentia.llm import linededup, queries
from evidentia.llm.common import LOWER_ASCII

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return line.strip(BLANK).encode().translate(LOWER_ASCII).decode()


def brute(rows):
    """Counter of (doc_id, n_lines, n_dropped, digest)."""
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 20:
                holders.setdefault(key_of(line), set()).add(-(1 << 63) if doc_id is None else doc_id)
    out = Counter()
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -(1 << 63) if doc_id is None else doc_id
        keep = [x for x in lines if len(holders.get(key_of(x), ())) < 3 or own == max(holders[key_of(x)])]
        out[doc_id, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.line_digests(df).collect())


A, B, C = "A line of some length, which many share", "  another LINE of good length\t", "één regel van twintig"
ROWS = [
    (1, f"{A}\n{B}\n{C}"), (2, f"{A}\n\n{A.upper()}\nown"), (3, f"\x0b{A} \r\n{B}"), (4, f"{B}\n{A}\n{B}\n"), (4, f"{C}\n{A}"), (4, f"{C}\n{A}"), (None, f"{A}\n{C}"), (None, f"{A}\nx"), (None, None),
    (5, None), (6, ""), (7, "\n\n"), (8, "nineteen characters"), (9, "nineteen characters"), (10, "nineteen characters"), (11, "twenty characters is."), (12, " twenty characters is."), (13, "TWENTY characters is. "),
    (14, "é" * 19), (15, "é" * 19), (16, "é" * 19), (17, "É" * 20), (18, "É" * 20), (19, "É" * 20), (20, "é" * 20), (21, " " + A), (22, " " + A), (23, " " + A), (24, "same line in one document only\n" * 9),
]


@pytest.mark.parametrize("seed", range(3))
def test_awkward_rows_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"line number {i} of a small pool" for i in range(12)] + ["short", "", A, B.strip()]
    rows = ROWS + [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in range(100, 160)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS row", "text AS keep", "doc_id AS H1").repartition(1 + seed)
    assert found(df) == brute(rows)


def test_a_line_of_every_document_is_cut_between_partitions(spark):
    long_text = "\n".join(f"line {i} of a text of over two megabytes, plain" for i in range(60_000))
    rows = [(i, f"{A}\nown line of document {i}") for i in range(3000)] + [(5000, long_text), (5001, long_text), (5002, long_text + "\n" + A)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert found(df) == brute(rows)


def test_the_bitmaps_give_the_text_back(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    maps = linededup.line_bitmaps(docs)
    assert all(r["keep"] is None or r["n_dropped"] for r in maps.collect())
    back = Counter((r["doc_id"], bytes(r["text"])) for r in linededup.kept_texts(docs, maps).collect())
    assert Counter((i, hashlib.sha256(t).hexdigest()) for i, t in back.elements()) == Counter((k[0], k[3]) for k in brute(ROWS).elements())


def test_empty_table(spark):
    assert linededup.line_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("at_once", [1, 3, 10, 1000])
@pytest.mark.parametrize("cut", [(), (7,), (5, 12, 13), (1, 2, 3, 4, 5, 6)])
def test_runs_across_pieces_and_partitions(at_once, cut):
    rng = random.Random(at_once)
    rows = sorted({(h, h, doc, doc) for h in range(4) for doc in [rng.randrange(9) for _ in range(rng.randrange(1, 9))]}, key=lambda r: (r[0], r[1], -r[2]))
    edges = [0, *[c for c in cut if c < len(rows)], len(rows)]
    gone, seen, open_ = set(), {}, set()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        table = pa.table([pa.array(c, pa.int64()) for c in zip(*rows[a:b], strict=True)] + [pa.array([b"\0\0\0\0"] * (b - a))], schema=linededup.LINES)
        for batch in linededup.stream(iter(table.to_batches(max_chunksize=2)), at_once):
            for r in batch.to_pylist():
                if r["state"] == linededup.GONE:
                    gone.add((r["h1"], r["doc"]))
                else:
                    open_.add((r["h1"], r["doc"]))
                    seen.setdefault(r["h1"], set()).update([r["doc"]] if r["state"] == linededup.SEEN else [])
    gone |= {(h, doc) for h, doc in open_ if len(seen[h]) >= 3 and doc < max(seen[h])}
    docs = {h: {r[2] for r in rows if r[0] == h} for h in range(4)}
    assert gone == {(h, doc) for h, ds in docs.items() if len(ds) >= 3 for doc in ds if doc < max(ds)}


def test_query_returns_the_columns_asked_for(spark):
    assert queries.op12_lines(spark, SF).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
