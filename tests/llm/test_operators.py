"""Brute force, held-out accuracy and awkward rows for the training-data operators."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from evidentia.llm import common, decontaminate, langid, lines, mixing, passages, rules, simhash, suffixes, toxicity, warc

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty, tiny, wordless, repeated and long texts.
ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, "some words without an id, quite a few of them indeed here", "de", "a", 3), (3, " \n\t ", "en", None, 4),
    (4, "a", "en", "b", 1), (5, "same words again and again " * 40, "en", "a", 9), (5, "same words again and again " * 40, "en", "a", 9), (6, "same words again and again " * 40, "fr", "b", 9),
    (7, "é" * 300, "fr", "c", 300), (8, " ".join(f"w{i}" for i in range(30_000)), "en", "c", 1), (9, "|||| ### !!!", "es", "d", 5), (10, "x\n" * 500, None, "d", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """The awkward rows with columns whose names clash with those that operators make."""
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("size", "score", "kept", "fp", "target", "words", "bin", "weight", "row", "h", "g", "rule", "copies", "source_size", "cuts", "text_hash", "__row", "__gone"):
        df = df.withColumn(c, df.doc_id)
    return df.repartition(3)


@pytest.fixture(scope="module")
def odd_labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (8, 1, 0), (9, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "lines": lambda d, lab: lines.line_quality(d, lab),
    "toxicity": lambda d, lab: toxicity.toxicity(d, lab),
    "rules": lambda d, lab: rules.quality_rules(d, lab),
    "suffixes": lambda d, lab: suffixes.exact_repeats(d),
    "mixing": lambda d, lab: mixing.mix(d),
    "langid": lambda d, lab: langid.language_id(d),
    "simhash": lambda d, lab: simhash.near_components(d, 3),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_awkward_row(odd, odd_labels, name):
    assert Counter(r["doc_id"] for r in OPERATORS[name](odd, odd_labels).collect()) == Counter(r[0] for r in ODD)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(odd, odd_labels, name):
    assert OPERATORS[name](odd.where("false"), odd_labels.where("false")).count() == 0
    assert OPERATORS[name](odd, odd_labels.where("false")).count() == len(ODD)


def test_pair_operators_take_awkward_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same words again and again same words"), (None, "x")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(odd, items).where("item_id = 3").collect()} == {5, 6}
    assert decontaminate.leaks(odd.where("false"), items).count() == 0
    assert decontaminate.leaks(odd, items.where("false")).count() == 0
    found = passages.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(6, 5)}
    assert passages.repeated_passages(odd.where("false")).count() == 0
    cut = passages.without(odd, passages.repeated_passages(odd))
    assert cut.columns == odd.columns and cut.where("doc_id = 6").count() == 0 and cut.count() == len(ODD) - 1
    assert {r["doc_id"] for r in simhash.near_copies(odd).collect()} >= {6}
    assert simhash.near_copies(odd.where("false")).count() == 0


def test_line_quality_on_held_out_labels(docs, labels):
    check_accuracy(lines.line_quality(docs, labels), labels, "quality", 0.97)


def test_toxicity_on_held_out_labels(docs, labels):
    check_accuracy(toxicity.toxicity(docs, labels), labels, "toxic", 0.85)


def check_accuracy(scored, labels, column, least):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = [(r["score"], truth[r["doc_id"]]) for r in scored.where("held_out").collect() if r["doc_id"] in truth]
    one, zero = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])
    assert auc >= least


def test_language_on_held_out_documents(docs):
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98


def brute_bits(texts, text):
    """Code length of text after texts, straight from the definition: escape method C, contexts of three bytes and fewer."""
    followers = {}
    pad = lambda t: b"\0\0\0" + t.lower()
    for t in map(pad, texts):
        for i in range(3, len(t)):
            for order in range(4):
                followers.setdefault((order, t[i - order : i]), Counter())[t[i]] += 1
    bits, t = 0.0, pad(text)
    for i in range(3, len(t)):
        p = 1.0
        for order in (3, 2, 1, 0):
            seen = followers.get((order, t[i - order : i]))
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if seen[t[i]]:
                p *= seen[t[i]] / (n + kinds)
                break
            p *= kinds / (n + kinds)
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


def test_code_lengths_equal_brute_force():
    import pyarrow as pa

    texts = {"a": [b"the cat sat on the mat", b"that is the Hat!"], "b": ["жили были дед и баба".encode(), b"x"], "c": [b"der hund, die katze", b""]}
    counts = {}
    for lang, own in texts.items():
        batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([t.decode() for t in own])], ["lang", "text"])
        rows = [r for b in langid.count_codes(iter([batch])) for r in b.to_pylist()]
        counts[lang] = (np.array([r["code"] for r in rows]), np.array([r["n"] for r in rows]))
    model = langid.fit(counts)
    probe = [b"the hat and the cat", "дед, the баба".encode(), b"", "Die Katze \u65e5\u672c".encode(), b"zzz"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    got = langid.code_lengths(model, data, np.r_[0, np.cumsum([len(p) for p in probe])])
    want = [[brute_bits(texts[lang], p) for lang in model.langs] for p in probe]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_languages_in_other_scripts_and_long_texts(spark):
    rng = random.Random(2)
    scripts = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщыэюя", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "th": "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอ", "zh": "的一是不了人我在有他这中大来上国"}
    word = lambda lang: "".join(rng.choice(scripts[lang]) for _ in range(rng.randrange(2, 8)))
    rows = [(i, " ".join(word(lang) for _ in range(6000 if i == 3 else 30)), lang) for i, lang in enumerate(list(scripts) * 40)]
    scripts["he"] = "אבגדהוזחטיכלמנסעפצקרשת"
    rows.append((1000, " ".join(word("he") for _ in range(200_000)), "he"))  # a language of one text over CHUNK_BYTES
    rows += [(2000 + i, word("he") + " " + word("he"), "he") for i in range(9)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    truth = {i: lang for i, _, lang in rows}
    out = [(r["lang_pred"], truth[r["doc_id"]], r["held_out"]) for r in got.collect()]
    assert np.mean([p == t for p, t, h in out if h]) > 0.95


def test_languages_whose_rows_share_an_id_are_learned(spark):
    rng = random.Random(5)
    words = {"de": "der die das und nicht ist mit von auch sich", "en": "the and that with have this from they will would", "nl": "het een van dat niet zijn met voor maar ook"}
    text = lambda lang: " ".join(rng.choices(words[lang].split(), k=12))
    for shared in (0, 3, 4, 9, 12):  # learnable ids of any hash
        rows = [(shared, text("de"), "de") for _ in range(1300)] + [(shared, "het een van dat", "nl")] * 900 + [(i, text("en"), "en") for i in range(1000, 1900)] + [(None, text("nl"), "nl")]
        got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where(f"doc_id = {shared}").groupBy("lang_pred").count().collect()
        assert {r["lang_pred"]: r["count"] for r in got} == ({"en": 2200} if zlib.crc32(b"%d" % shared) % 4 == 2 else {"de": 1300, "nl": 900})


def test_the_sample_of_a_language_never_vanishes():
    for n in (1, 600, 10**6, 629_145_600, 10**9, 10**13):
        assert 0.99 * min(1, langid.FIT_DOCS / n) <= langid.cut_of(n) / (1 << 63) <= 1.01 * min(1, langid.FIT_DOCS / n)


def test_language_of_letterless_texts(odd):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(odd).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 9)) and got[7][0] != "und"


def brute_counts(text):
    w = re.findall(WORD, text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    rows = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(repeated)


def test_rule_counts_equal_brute_force(docs, odd, labels):
    fitted = rules.fit(common.settle(rules.sample(docs, labels), "t"))
    for df in (docs, odd):
        for r in rules.judge(df, fitted).collect():
            want = brute_counts(r["text"])
            assert want == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [(truth[r["doc_id"]], r["kept"]) for r in rules.judge(docs, fitted).where("not base_failed").collect() if r["doc_id"] in truth]
    assert np.mean([k for y, k in out if y == 1]) > 0.97 and np.mean([k for y, k in out if y == 0]) < 0.3


def brute_cut(rows, length=100):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            else:
                seen[b[s : s + length]] = doc
        edges = gone & ~np.r_[False, gone[:-1]] if len(b) else gone
        out[doc] = (len(b), int(gone.sum()), int(edges.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_exact_repeats_equal_brute_force(spark, docs, monkeypatch):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 300").collect()]
    for i in range(150):
        a, b = rng.choice(rows)[1], rng.choice(rows)[1]
        k = rng.randrange(max(1, len(a)))
        rows.append((2000 + i, b[: rng.randrange(300)] + a[k : k + rng.randrange(20, 400)] + b[-rng.randrange(1, 200) :]))
    rows += [(3000, ""), (3001, "a" * 500), (3002, "ab" * 300), (3003, "x"), (3004, "b" * 99 + "a" * 100)]
    passage = rows[3][1][:300]
    rows += [(4000 + i, f"{rng.random()} " + passage + f" {i % 7} {rng.random()}") for i in range(60)]
    want = brute_cut(rows)
    for crowd in (suffixes.CROWD, 8):  # the second way of a crowd gives the same
        monkeypatch.setattr(suffixes, "CROWD", crowd)
        got = suffixes.exact_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def brute_rows(rows, length=100):
    """Digests by row: a string is earlier in a smaller doc_id (null first), or in the same row at an earlier start."""
    key = lambda i: -1 if i is None else i
    low = {}
    for doc, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            low[b[s : s + length]] = min(key(doc), low.get(b[s : s + length], 1 << 60))
    out = Counter()
    for doc, text in rows:
        b, seen = (text or "").encode(), set()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if low[x] < key(doc) or x in seen:
                gone[s : s + length] = True
            seen.add(x)
        out[doc, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


def test_exact_repeats_by_row(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = text(500), text(130)
    rows = [(1, a), (7, a), (7, text(400)), (None, a), (None, text(300)), (None, a), (7, b + text(50) + b), (7, b + text(60)), (9, text(90) + b), (9, None), (9, a), (9, a), (3, ""), (None, None), (None, b)]
    for crowd in (512, 1):
        monkeypatch.setattr(suffixes, "CROWD", crowd)
        got = suffixes.exact_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_rows(rows)


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    assert all(r["size"] == len(re.findall(WORD, r["text"] or "")) and 0 <= r["copies"] <= 3 for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.06 * own[0]["target"]
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect()}
    whole = mixing.mix(docs.withColumn("Copies", docs.doc_id), carry=True)
    assert {(r["doc_id"], r["text"], r["taken"]) for r in whole.collect()} == {(r["doc_id"], r["text"], r["taken"]) for r in rows}
    check_pareto(rows)
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def check_pareto(rows):
    """The order and the cut against a plain loop: whole copies, then rising odds while they fit, then the nearest in size."""
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        low, high = 0.0, 1e9
        for _ in range(200):  # the level at which expected copies, capped at 3, sum to the target
            mid = (low + high) / 2
            total = sum(min(3, mid * r["size"].bit_length()) * r["size"] for r in own)
            low, high = (mid, high) if total < own[0]["target"] else (low, mid)
        expected = {id(r): min(3.0, high * r["size"].bit_length()) for r in own}
        for r in own:
            assert r["copies"] - expected[id(r)] < 1 + 1e-6 and expected[id(r)] - r["copies"] < 1 + 1e-6 or r["size"] == 0


def test_targets_by_hand(spark):
    rows = [("a", 10), ("b", 1000), (None, 90)]  # weights 1, 2, 3 of 1100: a stops at 30, the null source at 270
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long"), 3).collect()}
    assert got["a"] == 30 and got[None] == 270 and got["b"] == pytest.approx(800)


def fingerprint(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_equals_brute_force(docs):
    some = docs.where("doc_id < 250")
    rows = simhash.near_components(some, 3).select("doc_id", simhash.hex16("fp").alias("fp"), "component_id").collect()
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    want = {i: fingerprint(t) for i, t in texts.items()}
    assert all(int(r["fp"], 16) == want[r["doc_id"]] and len(r["fp"]) == 16 for r in rows)
    ids = sorted(want)
    root = {i: i for i in ids}
    for _ in range(8):
        for i in ids:
            for j in ids:
                if bin(want[i] ^ want[j]).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert {r["doc_id"]: r["component_id"] for r in rows} == root


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]))
    index = simhash.GrayIndex(codes, np.zeros(len(codes), np.int64))
    got = {(int(x), int(y)) for a, b in index.links(3) for x, y in zip(a, b, strict=True)}
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None]) <= 3
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


def test_components_of_a_link_graph(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in common.linked(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 150: 100}
    assert common.linked(spark.createDataFrame([], "a long, b long")).count() == 0


def test_planted_passages_are_found(spark, docs):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 400").collect()]
    make = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    planted = []
    for i in range(60):
        p = make(rng.randrange(51, 140))
        q = p[:]
        for _ in range(i % 3 * len(p) // 100):
            q[rng.randrange(len(q))] = f"zzz{rng.randrange(9999)}"
        a, b = sorted(rng.sample(range(len(rows)), 2))
        rows[a] = (rows[a][0], rows[a][1] + " " + " ".join(p + make(9)))
        rows[b] = (rows[b][0], " ".join(make(9) + q) + " " + rows[b][1])
        planted.append((rows[b][0], rows[a][0]))
    got = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert np.mean([p in got for p in planted]) > 0.96


@pytest.mark.parametrize("boilerplate", [0, 20, 30, 40])
def test_passages_around_boilerplate_are_found(spark, boilerplate):
    rng = random.Random(boilerplate)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    common, rows, want = new(boilerplate), [], set()
    for i in range(200):
        p = common + new(55 - boilerplate)
        rows += [(i, " ".join(new(60) + p + new(60))), (1000 + i, " ".join(new(45) + p + new(70)))]
        want.add((1000 + i, i))
    rows += [(5000 + i, " ".join(new(80) + common + new(80))) for i in range(300)]
    got = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got & want) >= 0.95 * len(want) and not got - want


def test_passages_in_many_variants_are_found(spark):
    rng = random.Random(7)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    base, rows = new(60), []
    for v in range(40):
        w = base[:]
        for k in rng.sample(range(60), 2):
            w[k] = f"v{v}x{k}"
        rows += [(2 * v + c, " ".join(new(50) + w + new(50))) for c in range(2)]
    got = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(2 * v + 1 in got for v in range(40)) >= 38


def test_texts_under_one_id_are_cut_each_for_itself(spark):
    rng = random.Random(3)
    new = lambda n: " ".join(f"n{rng.randrange(10**9)}" for _ in range(n))
    p, rare = new(60), new(80)
    rows = spark.createDataFrame([(1, p, 1, 1), (2, new(20) + " " + p, 2, 2), (2, rare, 3, 3), (None, p, 4, 4), (3, p, 5, 5), (3, p, 5, 5)], "doc_id long, text string, text_hash long, cuts long")
    left = passages.without(rows, passages.repeated_passages(rows))
    assert left.columns == rows.columns
    texts = [(r["doc_id"], r["text"]) for r in left.collect()]
    # a row without an id comes behind the others: its copy of the first text goes, as that of the third document does
    assert (2, rare) in texts and (1, p) in texts and {i for i, _ in texts} == {1, 2}
    assert len(texts) == 3


def test_copies_of_repeated_ids(spark):
    rng = random.Random(3)
    new = lambda n: " ".join(f"n{rng.randrange(10**9)}" for _ in range(n))
    a, b = new(60), new(60)
    rows = [(7, a, "x", 1), (7, b, "y", 2), (8, a, "z", 3), (9, a + " more", None, 4), (None, a, "n", 5), (None, a, "n", 5), (7, a, "x", 1), (7, a, "v", 1), (5, None, "q", 6), (5, None, "q", 6)]
    for seed in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, h string, row long").repartition(seed)
        got = simhash.without_copies(df, simhash.near_copies(df))
        assert got.columns == df.columns
        left = Counter((r["doc_id"], r["text"]) for r in got.collect())
        assert left == Counter({(7, a): 1, (7, b): 1, (None, a): 2, (5, None): 2})
        kept = {r["h"] for r in got.where(f"doc_id = 7 and text = '{a}'").collect()}
        assert seed == 1 or kept == first
        first = kept


def test_edited_items_are_found(spark, docs):
    rng = random.Random(3)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    base = [r["text"] for r in docs.where("doc_id < 80").collect()]
    rows = []
    for i, text in items:
        w = text.split()
        for _ in range(int(0.1 * len(w))):
            w[rng.randrange(len(w))] = f"xq{rng.randrange(999)}"
        rows.append((i, base[i % 40] + " " + " ".join(w) + " " + base[40 + i % 40]))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert np.mean([(i, i) in got for i, _ in items]) > 0.97


def test_no_leak_in_clean_text(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "one two three is how any count begins, four five six seven is not the same at all here")], "doc_id long, text string")
    assert decontaminate.leaks(rows, items).count() == 0


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(1, 200)] + [(300, None, None), (301, "http://y", "é" * 5000), (None, "http://n", "<p>1</p>"), (302, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    assert len(got) == len(rows)
    for i, _, html in rows:
        if i is None:
            continue
        b, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        own = first[html or ""] == i
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[html or ""]))
        assert not own or bytes(r["payload"]) == b
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_ranges_own_each_record_once(tmp_path):
    import pyarrow.fs as pafs

    rng = np.random.default_rng(0)
    body = [rng.integers(0, 256, 3000, dtype=np.uint8).tobytes() + warc.MAGIC * 5 for _ in range(40)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"junk" + warc.MAGIC + b"more" + b"".join(warc.record(i, "u", b, None, False) for i, b in enumerate(body)))
    size = path.stat().st_size
    for step in (1000, 7777, size):
        got = [b.partition(b"\r\n\r\n")[2] for a in range(0, size, step) for _, b in warc.members(pafs.LocalFileSystem(), str(path), a, min(size, a + step))]
        assert got == body


def test_near_copies_equal_brute_force(spark, docs):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 300").collect()]
    for i in range(80):
        w = rng.choice(rows[:300])[1].split(" ")
        for _ in range(len(w) // 80):
            w[rng.randrange(len(w))] = f"q{rng.randrange(9999)}"
        rows.append((1000 + i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    root = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(8):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {i for i in root if root[i] != i}
    assert len(want - got) <= 0.04 * len(want) and not got - want


def test_near_copies_with_one_edited_stretch_are_found(spark, docs):
    rng = random.Random(9)
    base = [w for r in docs.collect() if r["text"] for w in [r["text"].split()] if 120 <= len(w) <= 300 and len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) == len(w) - 4][:60]
    base = [[f"t{i}x{w}" if k % 9 == 0 else w for k, w in enumerate(ws)] for i, ws in enumerate(base)]
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    edits = [lambda w: w[: -(len(w) * 15 // 100)], lambda w: w + new(len(w) // 5), lambda w: w[: -(len(w) * 9 // 100)] + new(len(w) * 9 // 100)]
    rows, want = [], set()
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        for j, e in enumerate(edits):
            v = e(w)
            x, y = ({tuple(u[k : k + 5]) for k in range(len(u) - 4)} for u in (w, v))
            if len(x & y) >= 0.8 * len(x | y):
                rows.append((1000 * (j + 1) + i, " ".join(v)))
                want.add(1000 * (j + 1) + i)
    got = {r["doc_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(want) > 100 and len(want - got) <= 0.01 * len(want)


def test_near_copies_among_many_variants_of_a_template_are_found(spark, monkeypatch):
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def edited(w, n):
        w = w[:]
        for i in rng.sample(range(0, len(w), 6), n):
            w[i] = f"v{rng.randrange(10**9)}"
        return w

    rows, want = [], set()
    for i in range(300):
        v = edited(base, 4)
        rows += [(i, " ".join(v)), (5000 + i, " ".join(v[:80] + [f"c{i}"] + v[81:]))]
        want.add(5000 + i)
    monkeypatch.setattr(simhash, "TILE", 100)
    got = {r["doc_id"]: r["keeper"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert want <= set(got)
    words = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                if x != y:
                    for k, r in root.items():
                        root[k] = min(x, y) if r in (x, y) else r
    assert {i: r for i, r in root.items() if i != r} == got


def test_items_of_every_length_are_found_at_the_edge_of_a_leak():
    import pyarrow as pa

    rng = random.Random(5)
    sizes = [n for n in (3, 5, 9, 10, 11, 12, 13, 14, 15, 17, 19, 20, 25, 30, 50) for _ in range(12)] + [100] * 24
    items = [[f"i{i}w{k}" for k in range(n)] for i, n in enumerate(sizes)]
    index = decontaminate.Index(list(range(len(items))), pa.array([" ".join(w) for w in items]))
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    missed, tried = Counter(), Counter()
    for i, w in enumerate(items):
        most = decontaminate.allowed(len(w))
        scattered, at = list(w), rng.randrange(len(w) - most + 1)
        for k in sorted(rng.sample(range(len(w)), most), reverse=True):
            scattered[k : k + 1] = rng.choice(([], ["xx"], [scattered[k], "xx"]))
        for v in (scattered, w[:at] + w[at + most :], w[:at] + fresh(most) + w[at + most :], w[: len(w) - most]):
            data = np.frombuffer(" ".join(fresh(30) + v + fresh(30)).encode(), np.uint8)
            text, item, start, stop, distance = index.leaks(data, np.array([0, len(data)]))
            missed[len(w)] += i not in item
            tried[len(w)] += 1
            assert all(words_apart(w, data.tobytes().decode().split()[a:b]) == d for j, a, b, d in zip(item, start, stop, distance, strict=True) if j == i)
    assert all(missed[n] <= 0.05 * tried[n] for n in tried) and sum(missed.values()) <= 0.01 * sum(tried.values())


def words_apart(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice((1, 2, 4, 6, 9, 12, 16, 24)))) for i in range(24)]
    docs = []
    for i in range(60):
        w = items[i % 24][1][:]
        for _ in range(rng.randrange(0, decontaminate.allowed(len(w)) + 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, text(rng.randrange(30)) + w + text(rng.randrange(30))))
    want = set()
    for i, w in docs:
        for j, item in items:
            m = decontaminate.allowed(len(item))
            if any(words_apart(item, w[a : a + n]) <= m for a in range(len(w)) for n in range(max(1, len(item) - m), len(item) + m + 1)):
                want.add((i, j))
    of = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(of(docs, "doc_id"), of(items, "item_id")).collect()}
    assert not got - want and len(want - got) <= 0.02 * len(want)
    left = {r["doc_id"] for r in decontaminate.without_leaks(of(docs, "doc_id"), of(items, "item_id")).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}


def test_a_phrase_repeated_beside_a_passage_does_not_hide_it():
    token = lambda n, at: np.arange(at, at + n).astype(np.uint64) * np.uint64(7919)
    passage = token(56, 1)
    for where in (0, 30, 55):
        before, behind = token(70, 1000), token(70, 2000)
        before[0], behind[-1] = passage[where], passage[where]
        mine = np.r_[token(20, 3000), passage, token(20, 4000)]
        for theirs in (np.r_[before, passage], np.r_[passage, behind], np.r_[before, passage, behind], np.r_[token(70, 5000), passage, before, behind]):
            assert passages.alike(mine, theirs) == [(20, 76, 1.0)]
    twice = np.r_[passage, token(30, 3000), passage]  # two passages of mine at two shifts
    assert passages.alike(twice, passage) == [(0, 56, 1.0), (86, 142, 1.0)]
    assert passages.alike(token(100, 9000), passage) == []


def test_crowds_are_linked_as_by_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, 150, dtype=np.uint32)
    sets = []
    for i in range(300):
        own = base.copy()
        own[rng.random(150) < rng.choice([0.03, 0.1, 0.25])] = rng.integers(0, 40)  # few replacements, so that variants share them
        sets.append(np.unique(np.r_[own, sets[i - 1][:6] if i % 7 == 0 and i else own[:0]]))
    bound = simhash.Overlaps(sets)
    x, y = np.triu_indices(len(sets), 1)
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    assert (bound.most(x, y) >= both).all() and (bound.most(y, x) == bound.most(x, y)).all()
    assert all(bound.shared[i] >= both[(x == i) | (y == i)].max() for i in range(len(sets)))
    tile = np.arange(len(sets)) % 3
    n, fp = len(sets), np.zeros(len(sets), np.int64)

    def batches():
        for p in range(3):
            for q in range(p, 3):
                for part in np.array_split(np.flatnonzero((tile == p) | (tile == q)), 4):
                    fill = [np.full(len(part), v) for v in (1, p, q)]
                    columns = [*fill, tile[part], part, part, fp[part]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array([sets[i].tobytes() for i in part], pa.binary())], [f"c{i}" for i in range(8)])

    links = [(a, b) for out in simhash.crowd_links(batches(), 0.8) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    good = both >= 0.8 * (bound.size[x] + bound.size[y] - both)
    assert set(map(frozenset, links)) <= {frozenset(p) for p in zip(x[good].tolist(), y[good].tolist(), strict=True)}
    a, b = np.array(links).T
    assert (simhash.forest(n, iter([(a, b)])) == simhash.forest(n, iter([(x[good], y[good])]))).all()
    few = simhash.Overlaps([base[:9], base[5:7], base[20:30]])
    assert few.most(np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [2, 0, 0] and few.shared.tolist() == [2, 2, 0]
