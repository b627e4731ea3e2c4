"""Plain loops beside the fitted models and the mix: marginals, label model, Pareto order; texts longer than a chunk."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, langid, lines, mixing, rules, simhash, suffixes, toxicity
from evidentia.llm.common import CHUNK_BYTES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("long", "block"), [(4096, 512), (3, 4), (0, 1), (5, 3)])
def test_marginals_equal_a_sum_over_all_labellings(monkeypatch, long, block):
    monkeypatch.setattr(lines, "LONG", long)
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = np.random.default_rng(0)
    size = [1, 4, 0, 7, 2, 9]
    ends = np.r_[0, np.cumsum(size)]
    unary, trans = rng.normal(0, 2, ends[-1]), rng.normal(0, 1, (2, 2))
    good, both = lines.marginals(unary, trans, ends)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        total, one, pair = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = math.exp(sum(unary[a + i] * v for i, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y[:-1], y[1:], strict=True)))
            total += w
            one += w * np.array(y, float)
            for i in range(1, len(y)):
                pair[i, y[i - 1], y[i]] += w
        assert np.allclose(good[a:b], one / total) and np.allclose(both[a:b], pair / total)


def test_a_text_of_many_lines_goes_by_blocks():
    rng = np.random.default_rng(6)
    ends = np.array([0, 5, 60_005, 60_020])
    unary, trans = rng.normal(0, 3, ends[-1]), rng.normal(0, 2, (2, 2))
    by_blocks = lines.marginals(unary, trans, ends)
    plain = [np.zeros(ends[-1]), np.zeros((ends[-1], 2, 2))]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        one = [lines.marginals(unary[a : a + n], trans, np.array([0, n])) for n in [min(4000, b - a)]]
        plain[0][a : a + len(one[0][0])], plain[1][a : a + len(one[0][0])] = one[0]
    inside = np.r_[0:5, 5:3905, 60_005:60_020]  # the far end of what was cut at 4,000 lines is forgotten by then
    assert np.allclose(by_blocks[0][inside], plain[0][inside]) and np.allclose(by_blocks[1][inside], plain[1][inside])
    assert np.isfinite(by_blocks[0]).all() and np.allclose(by_blocks[1][6:60_005].sum((1, 2)), 1)


def information(v, p):
    """Mutual information of each two voters given the class, by counting."""
    n, k = v.shape
    out = np.zeros((k, k))
    for weight in (1 - p, p):
        total = weight.sum()
        for i, j in itertools.permutations(range(k), 2):
            for a, b in itertools.product((0, 1), repeat=2):
                ab, pa, pb = (weight[x].sum() / total for x in ((v[:, i] == a) & (v[:, j] == b), v[:, i] == a, v[:, j] == b))
                out[i, j] += total / n * (ab * math.log(ab / (pa * pb)) if ab > 1e-12 else 0)
    return out


def test_the_forest_is_a_heaviest_one():
    rng = np.random.default_rng(1)
    for k in (2, 4, 6):
        v = (rng.random((400, k)) < 0.3).astype(np.int8)
        v[:, 1] = v[:, 0] ^ (rng.random(400) < 0.1)
        if k > 3:
            v[:, 3] = v[:, 2] | (rng.random(400) < 0.2)
        p = rng.random(400)
        gain, parent = information(v, p), toxicity.forest(v, p)
        group, weight = list(range(k)), 0.0
        for w, i, j in sorted(((gain[i, j], i, j) for i, j in itertools.combinations(range(k), 2)), reverse=True):
            if w > 5 / 400 and group[i] != group[j]:
                weight += w
                group = [group[i] if g == group[j] else g for g in group]
        assert sum(gain[a, b] for b, a in enumerate(parent) if a >= 0) == pytest.approx(weight)


def test_the_label_model_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(2)
    y = rng.random(150) < 0.3
    v = np.array([[rng.random() < (0.7 if t else 0.1) for _ in range(5)] for t in y], np.int8)
    v[:, 4] = v[:, 3] ^ (rng.random(150) < 0.05)
    rounds, prior = 6, 0.3
    p = [1 / (1 + math.exp(-(2.0 * int(r.sum()) - 3.0))) for r in v]
    for step in range(rounds):
        if step in (0, rounds // 2):
            parent = toxicity.forest(v, np.array(p))
        new = []
        for row in v:
            log = [math.log(1 - prior), math.log(prior)]
            for c in (0, 1):
                weight = [q if c else 1 - q for q in p]
                for j in range(5):
                    g = int(row[parent[j]]) if parent[j] >= 0 else 0
                    same = [w for w, r in zip(weight, v, strict=True) if parent[j] < 0 or r[parent[j]] == g]
                    ones = sum(w for w, r in zip(weight, v, strict=True) if (parent[j] < 0 or r[parent[j]] == g) and r[j])
                    q = min(1 - 1e-4, max(1e-4, (ones + 0.05) / (sum(same) + 1)))
                    log[c] += math.log(q if row[j] else 1 - q)
            new.append(1 / (1 + math.exp(log[0] - log[1])))
        p = new
    assert np.allclose(toxicity.label_model(v, prior, rounds), p)
    truth = toxicity.label_model(v, prior)
    assert truth[y].mean() > 0.6 and truth[~y].mean() < 0.2


def test_the_mix_equals_a_plain_walk(spark):
    """Whole copies, then the others by rising odds until the next one doesn't fit, then the one nearest in size to the rest."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hashed = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", mixing.F.regexp_count("text", F.lit(mixing.WORD)).cast("long"), F.lit(42)), F.lit(1 << 52)).alias("u"))
    u = {r["doc_id"]: (float(r["u"]) + 0.5) / (1 << 52) for r in hashed.collect()}
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len({r["source"] for r in rows}) > 5
    for s in {r["source"] for r in rows}:
        own, target = [r for r in rows if r["source"] == s], next(r["target"] for r in rows if r["source"] == s)
        classes = sorted({r["size"].bit_length() for r in own}, reverse=True)
        words = {c: sum(r["size"] for r in own if r["size"].bit_length() == c) for c in classes}
        full = 0
        while full < len(classes):  # the heaviest classes are full as long as their share would exceed the cap
            rest = sum(words[c] * c for c in classes[full:])
            level = (target - 3 * sum(words[c] for c in classes[:full])) / rest if rest else 0.0
            if level * classes[full] < 3:
                break
            full += 1
        expected = {c: 3.0 if i < full else level * c for i, c in enumerate(classes)}
        whole = {c: math.floor(e + 1e-9) for c, e in expected.items()}
        p = {c: max(0.0, expected[c] - whole[c]) for c in classes}
        lack = max(0.0, target - sum(whole[c] * words[c] for c in classes))
        odds = {r["doc_id"]: u[r["doc_id"]] / (1 - u[r["doc_id"]]) / (p[c] / (1 - p[c])) for r in own if p[c := r["size"].bit_length()] > 0 and r["size"] > 0}
        order = sorted((r for r in own if r["doc_id"] in odds), key=lambda r: (odds[r["doc_id"]], r["doc_id"]))
        taken, upto = set(), 0
        for r in order:
            if upto + r["size"] > lack:
                break
            taken.add(r["doc_id"])
            upto += r["size"]
        near = sorted((abs(r["size"] - (lack - upto)), odds[r["doc_id"]], r["doc_id"]) for r in order if r["doc_id"] not in taken and abs(r["size"] - (lack - upto)) < lack - upto)
        taken |= {near[0][2]} if near else set()
        assert {r["doc_id"]: r["copies"] for r in own} == {r["doc_id"]: whole[r["size"].bit_length()] + (r["doc_id"] in taken) for r in own}


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text over CHUNK_BYTES between short ones; its end holds a benchmark item and what a short text repeats."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    body = [word() for _ in range(420_000)]
    item = [word() for _ in range(20)]
    text = " ".join([*body[:-300], *item, *body[-300:]])
    assert len(text) > CHUNK_BYTES + 100_000
    rows = [(1, "a short text before, of ordinary words that say little", "en", "a"), (2, text, "en", "a"), (3, text[-400:], "en", "b"), (4, "a short text behind", "en", "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1), " ".join(item)


def test_long_texts_are_whole_for_every_operator(spark, long_docs):
    rows, docs, item = long_docs
    text = rows[1][1]
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    words = text.split()
    found = {r["doc_id"]: r for r in rules.quality_rules(docs, labels).collect()}
    assert (found[2]["n_words"], found[2]["word_chars"], found[2]["n_repeat_words"], found[2]["n_dup_lines"]) == (len(words), sum(map(len, words)), 0, 0)
    cut = {r["doc_id"]: r for r in suffixes.exact_repeats(docs).collect()}
    assert cut[2]["n_removed"] == 0 and cut[2]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest() and (cut[3]["n_bytes"], cut[3]["n_removed"], cut[3]["n_spans"]) == (400, 400, 1)
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}[2] == len(words)
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    leaks = [(r["doc_id"], r["start_word"]) for r in decontaminate.leaks(docs, items).collect()]
    assert leaks == [(2, len(words) - 320)]
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], np.uint64)
    fingerprint = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert {r["doc_id"]: int(r["fp"]) & (1 << 64) - 1 for r in simhash.near_components(docs, 3).select("doc_id", "fp").collect()}[2] == fingerprint
    assert {r["doc_id"] for r in langid.language_id(docs).where("lang_pred = 'en'").collect()} >= {1, 2}
    for operator in (lines.line_quality, toxicity.toxicity):
        both = [{r["doc_id"]: r["score"] for r in operator(df, labels).collect()} for df in (docs, docs.repartition(4, "doc_id"))]
        assert both[0] == pytest.approx(both[1]) and set(both[0]) == {1, 2, 3, 4}
