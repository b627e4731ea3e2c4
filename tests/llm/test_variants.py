"""Spelling variants against a brute force over all pairs, long posting lists in pieces and tiles, awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import variants

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    kin = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        kin[w] = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
    form = {}
    for w, ws in kin.items():
        top = max((words[x] for x in ws), default=0)
        form[w] = min(x for x in ws if words[x] == top) if top >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(kin[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_words_of_the_corpus_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(variants.spelling_variants(docs)) == want
    assert any(w[0] for w in want.values()) and any(w[3] for w in want.values())


CHAIN = [(1, " ".join(["abcdefgh"] * 2 + ["abcdefgx"] * 20 + ["abcdefyx"] * 200 + ["abcdezyx"] * 2000))]
AWKWARD = [
    (1, None), (2, ""), (None, "Zebrafish zebrafish ZEBRAFISHES zebrafishes"), (3, "Éclairs éclairs éclairs eclairs eclairs"), (3, "Éclairs éclairs éclairs eclairs eclairs"), (4, "aaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaaa " * 3), (5, "abababab babababa ababababa " * 4), (6, "short six666 words7 " * 9),
    (7, "q" * 70_000 + " " + "q" * 69_999 + "z " + "q" * 70_000 + " " + "q" * 69_999 + "z"), (8, "won’t×multiplied÷divided multipliedly œuvrehigh " * 3), (None, None),
]


def test_chains_and_awkward_rows_equal_brute_force(spark):
    rows = CHAIN + AWKWARD + [(i, "plain text of copies repeated") for i in range(40)]
    want = brute(rows)
    assert want["abcdefgh"][1] == "abcdezyx" and want["abcdefgh"][0] == "abcdefgx"
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS word", "text AS n", "doc_id AS key").repartition(3)
    assert found(variants.spelling_variants(df)) == want


def test_an_empty_table_has_no_words(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "tiny"), (2, None)], "doc_id long, text string")).count() == 0


def test_long_posting_lists_are_dealt_over_tiles(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = variants.vocabulary(docs)
    pairs = lambda: sorted((min(r["a"], r["b"]), max(r["a"], r["b"]), r["a_n"] + r["b_n"]) for r in variants.near_words(words).collect())
    want = pairs()
    monkeypatch.setattr(variants, "CROWD", 3)
    assert pairs() == want


@pytest.mark.parametrize("size", [1, 7, 50])
def test_groups_in_pieces_give_the_same_pairs(monkeypatch, size):
    stem = [f"{a}{b}cdefghij" for a in "kmnprst" for b in "aeiou"] + [f"{a}{b}cdefgij" for a in "kmn" for b in "ae"]
    key = int(variants.key_of(np.array([int.from_bytes(b"hij", "big")]), np.array([7]), np.array([10]))[0])
    rows = [(key, 0, 0, int(len(w) < 10), w.encode(), 5) for w in stem if len(w) == 10] + [(key, 0, 1, 1, w.encode(), 5) for w in stem if len(w) == 9]
    table = pa.table({n: pa.array(c, t) for (n, t), c in zip([("key", pa.int64()), ("tile", pa.int32()), ("role", pa.int8()), ("shorter", pa.int8()), ("word", pa.binary()), ("n", pa.int64())], zip(*rows, strict=True), strict=True)})
    monkeypatch.setattr(variants, "ROWS", size)
    got = {tuple(sorted((r["a"], r["b"]))) for b in variants.match(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()}
    words = [r[4] for r in rows]
    assert got == {tuple(sorted((a, b))) for a in words for b in words if a < b and near(a, b) and not len(a) == len(b) == 9}
