"""Source divergence against a brute force over every term of every pair, with tiles, large sums and awkward rows."""

import random
import re
from collections import Counter

import pytest

from evidentia.llm import divergence
from evidentia.llm.common import LOWER_ASCII

SF = "/root/testdata/sf0.001"


def brute(rows, least=3, top=200):
    counts, docs, groups = {}, {}, set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", (text or "").encode().translate(LOWER_ASCII).decode()
        groups.add((lang, source))
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        counts.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(found.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: [counts[lang, s][t] for t in kept] for x, s in groups if x == lang}
        price = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        whole = price([sum(c[i] for c in own.values()) for i in range(len(kept))])
        p = {s: price(c) for s, c in own.items()}
        for s in own:
            values = {x: sum((a - b) ** 2 // b for a, b in zip(p[s], p[x], strict=True)) for x in own if x != s}
            terms = {t: (a - q) ** 2 // q for t, a, q, c in zip(kept, p[s], whole, own[s], strict=True) if c > 0 and a > q}
            for part, found in (("pair", values), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def found(df):
    rows = [tuple(r) for r in divergence.source_divergence(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_the_corpus_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["lang"], r["source"], r["text"]) for r in docs.collect()])
    assert len(want) > 500 and found(docs) == want


DDL = "lang string, source string, text string"
ROWS = [
    (None, None, "a b c a"), ("", "", "a B c A"), (None, "s", "A-b_c 1x2"), ("", "t", None), ("en", "x", None), ("en", "y", ""), ("de", "only", "eins zwei eins"), ("de", "only", "eins zwei"), ("de", "only", "eins zwei drei"),
    ("fr", "u", "été ÉTÉ naïve"), ("fr", "v", "été naïve ’’ naïve"), ("fr", "w", "été " * 4000 + "naïve"), ("fr", "w", "0 1 2"), ("fr", "z", "..."), ("fr", None, "été"), ("es", "k", "unico"), ("es", "l", "otro"),
]


@pytest.mark.parametrize("tile", [256, 1])
def test_awkward_rows_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    df = spark.createDataFrame(ROWS, DDL).selectExpr("lang", "source", "text", "lang AS gid", "text AS term", "source AS n", "lang AS p0").repartition(3)
    assert found(df) == brute(ROWS)


def test_ranks_and_ties_and_a_hot_source(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "xyzuvw" for c in "klmnopqr"]
    rows = [("en", "hot" if i % 3 else f"s{i % 9}", " ".join(rng.choices(words, k=60))) for i in range(300)]
    rows += [("en", f"tie{k}", "axk bxk cxk") for k in range(3)] + [("en", "long", " ".join(words) * 700)]
    want = brute(rows)
    assert max(r[5] for r in want if r[2] == "term") == 200
    assert found(spark.createDataFrame(rows, DDL).repartition(4)) == want


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DDL)).count() == 0


def test_sums_over_the_range_of_longs_are_exact(spark):
    values = [2**62, 2**62, 2**62, 2**63 - 1, -5, -(2**62), 7, -(2**63)]
    got = spark.createDataFrame([(v,) for v in values * 3], "x long").agg(divergence.exact_sum(divergence.F.col("x")).alias("s")).first()["s"]
    assert int(got) == 3 * sum(values)
