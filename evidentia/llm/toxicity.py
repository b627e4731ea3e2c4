"""Toxicity: lexicon and pattern voters, a generative model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, fold, text_arrays
from .lines import labelled, logistic
from .textbytes import LETTER, LOWER, Hasher, owner, spans

#: Labelled documents used at most (of smallest hash), none longer than so many bytes.
FIT_DOCS, FIT_TEXT_BYTES = 8000, 1 << 17
#: Lexicon entries found at most, toxic documents an entry must be in (and their share), lexicons they are dealt to.
ENTRIES, SUPPORT, SUPPORT_SHARE, LEXICONS = 1024, 3, 0.03, 24
#: Besides whole words, beginnings of words of so many bytes are entries.
PREFIXES = (4, 5, 6, 7)
WHOLE = np.uint64(0x5BD1E9955BD1E995)
#: A beginning counts only in texts where it starts one word in so many: long texts hold any of them once by chance.
DENSE = 350
#: The surest entries vote alone, so many of them; the others vote in lexicons.
ALONE = 32
#: Parts of the hashes that are counted one after the other while fitting.
PASSES = 4

# Common insults.
INSULTS = {
    "en": "stupid idiot moron loser pathetic worthless trash disgusting scum clown dumb hate ugly fool garbage freak creep",
    "de": "idiot dumm trottel arschloch abschaum widerlich versager",
    "fr": "idiot imbécile connard débile crétin ordure minable",
    "es": "idiota estúpido imbécil basura asqueroso patético inútil",
}


def entries(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of every word of letters, lower-cased in ASCII, and of its beginnings; the words of each text."""
    low = LOWER[data]
    start, stop = spans(LETTER[low], ends)
    text, h = owner(ends, start), Hasher(low)
    out = [(text, (h(start, stop) ^ WHOLE) | np.uint64(1))]
    for n in PREFIXES:
        long = stop - start > n
        out.append((text[long], h(start[long], start[long] + n) & ~np.uint64(1)))
    return np.concatenate([t for t, _ in out]), np.concatenate([x for _, x in out]), np.bincount(text, minlength=len(ends) - 1)


def whole(h: np.ndarray) -> np.ndarray:
    """The last bit of an entry's hash tells whole words from beginnings."""
    return (h & np.uint64(1)).astype(bool)


def counted(text: np.ndarray, at: np.ndarray, kinds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, entry, strength): times of a whole word, times against DENSE of a beginning that is dense enough."""
    size = max(1, len(kinds))
    pair, times = np.unique(text * np.int64(size) + at, return_counts=True)
    text, at = pair // size, pair % size
    strength = np.where(whole(kinds[at]), times, times * DENSE / np.maximum(words[text], 1)) if len(at) else times.astype(float)
    keep = strength >= 1
    return text[keep], at[keep], 1 + np.log(strength[keep])


def hashes_of(words: str) -> np.ndarray:
    data, ends = text_arrays(pa.array(words.split()))
    return (Hasher(LOWER[data])(ends[:-1], ends[1:]) ^ WHOLE) | np.uint64(1)


@dataclass
class Lexicon:
    """Entries sorted by hash, and a bit table that rules most words out."""

    known: np.ndarray

    def __post_init__(self):
        self.table = np.zeros(1 << 20, bool)
        self.table[self.known & np.uint64((1 << 20) - 1)] = True

    def hits(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, entry, strength) of the entries that occur."""
        text, h, words = entries(data, ends)
        may = self.table[h & np.uint64((1 << 20) - 1)]
        text, h = text[may], h[may]
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        sure = self.known[at] == h if len(self.known) else np.zeros(0, bool)
        return counted(text[sure], at[sure], self.known, words)


def slices(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Whole texts of about CHUNK_BYTES at a time, so that fitting needs no more memory than scoring."""
    start, n = 0, len(ends) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK_BYTES, "right")) - 1)
        yield slice(start, stop), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by hash."""
    kinds, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    out = np.zeros((len(kinds), 2))
    np.add.at(out, at, np.concatenate([c for _, c in parts]))
    return kinds, out


def entries_met(data: np.ndarray, ends: np.ndarray, toxic: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of one part of the hashes that SUPPORT toxic texts hold, and how many clean and toxic texts do."""
    kinds, inside = np.zeros(0, np.uint64), np.zeros((0, 2))
    for rows, part, bounds in slices(data, ends):
        text, h, words = entries(part, bounds)
        mine = (h >> np.uint64(20)) % np.uint64(PASSES) == p
        text, h = text[mine], h[mine]
        own, at = np.unique(h, return_inverse=True)
        text, at, _ = counted(text, at, own, words)
        bad = toxic[rows][text]
        kinds, inside = merged([(kinds, inside), (own, np.stack([np.bincount(at[~bad], minlength=len(own)), np.bincount(at[bad], minlength=len(own))], 1).astype(float))])
    often = inside[:, 1] >= SUPPORT
    return kinds[often], inside[often]


def find_entries(data: np.ndarray, ends: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the entries that mark toxic documents best, best first, and their log odds."""
    passes = [entries_met(data, ends, toxic, p) for p in range(PASSES)]
    kinds, inside = (np.concatenate(x) for x in zip(*passes, strict=True))
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    in0, in1 = inside.T
    odds = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    sure = odds - 1.64 * np.sqrt(1 / (in1 + 0.5) + 1 / (in0 + 0.5))  # a lower bound: rare entries must be purer
    good = np.flatnonzero((in1 >= max(SUPPORT, SUPPORT_SHARE * n1)) & (sure > 1))
    good = good[np.argsort(-sure[good], kind="stable")][:ENTRIES]
    return kinds[good], odds[good]


def votes(data: np.ndarray, ends: np.ndarray, lexicon: Lexicon, voter_of: np.ndarray) -> np.ndarray:
    """[texts, voters] of 0 and 1: single entries, dealt lexicons, one list of insults a language, and patterns."""
    n = len(ends) - 1
    text, entry, strength = lexicon.hits(data, ends)
    lists = ALONE + LEXICONS
    out = np.zeros((n, lists + len(INSULTS) + 3), np.int8)
    out[text, voter_of[entry]] = 1
    for j, words in enumerate(INSULTS.values()):
        t, _, _ = Lexicon(np.sort(hashes_of(words))).hits(data, ends)
        out[t, lists + j] = 1
    kinds, total = np.bincount(text, minlength=n), np.bincount(text, strength, n)
    size = np.maximum(np.diff(ends), 1)
    shout = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 33, out=shout[1:])
    base = lists + len(INSULTS)
    out[:, base] = kinds >= 2
    out[:, base + 1] = total >= 4
    out[:, base + 2] = 200 * (shout[ends[1:]] - shout[ends[:-1]]) >= size
    return out


def label_model(v: np.ndarray, prior: float, rounds: int = 30) -> np.ndarray:
    """P(toxic) of each row of votes under a generative model fitted without labels, by expectation maximisation.

    Given the class, voters form a forest: each depends on one other at most. The forest is the maximum spanning tree
    of the voters' mutual information given the class, over links that are clearly not chance; it is found again
    half-way. The model's tables are the voters' accuracies and their correlations.
    """
    n, k = v.shape
    p = 1 / (1 + np.exp(-(2.0 * v.sum(1) - 3.0)))
    parent = np.full(k, -1)
    for step in range(rounds):
        if step in (0, rounds // 2):
            parent = forest(v, p)
        log = np.zeros((n, 2))
        for y, weight in enumerate((1 - p, p)):
            log[:, y] = np.log(prior if y else 1 - prior)
            for j in range(k):
                group = v[:, parent[j]] if parent[j] >= 0 else np.zeros(n, np.int8)
                ones = np.bincount(group, weight * v[:, j], 2) + 0.05
                alls = np.bincount(group, weight, 2) + 1
                q = np.clip(ones / alls, 1e-4, 1 - 1e-4)[group]
                log[:, y] += np.where(v[:, j] > 0, np.log(q), np.log(1 - q))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
    return p


def forest(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Parent of each voter, -1 for none."""
    n, k = v.shape
    gain = np.zeros((k, k))
    for weight in (1 - p, p):
        total = weight.sum() + 1e-9
        one = (v * weight[:, None]).sum(0) / total
        joint = (v * weight[:, None]).T.astype(float) @ v / total
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (one if a else 1 - one)[:, None], (one if b else 1 - one)[None]
                ab = joint if a and b else one[:, None] - joint if a else one[None] - joint if b else 1 - one[:, None] - one[None] + joint
                gain += total / n * np.where(ab > 1e-12, ab * np.log(np.maximum(ab, 1e-12) / np.maximum(pa_ * pb, 1e-12)), 0)
    np.fill_diagonal(gain, 0)
    parent, inside = np.full(k, -1), np.zeros(k, bool)
    for _ in range(k):
        best = np.where(inside[:, None] & ~inside[None], gain, -1)
        a, b = divmod(int(best.argmax()), k)
        if best[a, b] > 5 / n:
            parent[b], inside[b] = a, True
        elif not inside.all():
            inside[int(np.flatnonzero(~inside)[0])] = True
    return parent


@dataclass
class Classifier:
    lexicon: Lexicon
    weights: np.ndarray
    offset: float
    slope: float
    base: float

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        text, entry, strength = self.lexicon.hits(data, ends)
        s = np.bincount(text, self.weights[entry] * strength, len(ends) - 1) + self.offset if len(self.weights) else np.full(len(ends) - 1, self.offset)
        return 1 / (1 + np.exp(-np.clip(self.slope * s + self.base, -30, 30)))


def fit(texts: pa.Array, toxic: np.ndarray) -> Classifier:
    """Entries from the labelled texts, votes, posterior labels, then logistic weights of the entries on these."""
    data, ends = text_arrays(texts)
    if not toxic.any() or toxic.all():
        p = (toxic.sum() + 1) / (len(toxic) + 2) if len(toxic) else 0.5
        return Classifier(Lexicon(np.zeros(0, np.uint64)), np.zeros(0), 0.0, 0.0, float(np.log(p / (1 - p))))
    best, _ = find_entries(data, ends, toxic)
    known = np.unique(np.r_[best, *[hashes_of(w) for w in INSULTS.values()]])
    lexicon = Lexicon(known)
    # the rest is dealt by hash order, so that every lexicon has entries of all kinds and languages
    voter_of = ALONE + np.arange(len(known)) % LEXICONS
    voter_of[np.searchsorted(known, best[:ALONE])] = np.arange(len(best[:ALONE]))
    parts = list(slices(data, ends))
    posterior = label_model(np.concatenate([votes(d, e, lexicon, voter_of) for _, d, e in parts]), float(toxic.mean()))
    found = [(rows.start + t, i, x) for rows, d, e in parts for t, i, x in [lexicon.hits(d, e)]]
    text, entry, x = (np.concatenate(c) for c in zip(*found, strict=True))
    n = len(texts)
    w, b = np.zeros(len(known)), float(np.log(toxic.mean() / (1 - toxic.mean())))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, w[entry] * x, n) + b, -30, 30)))
        r = posterior - p
        g = np.r_[np.bincount(entry, r[text] * x, len(w)) / n - 5e-5 * w, r.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w + move[:-1], b + move[-1]
    s = np.bincount(text, w[entry] * x, n) + b
    slope, base = logistic(s, toxic.astype(float))
    return Classifier(lexicon, w, b, slope, base)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Labels of the held-out fold are never read for fitting.

    Null and empty texts have the score of a text without any entry. Without usable labels every score is the base rate
    (0.5 if there are none). A null doc_id isn't held out. Other columns of docs are not read.
    """
    found = labelled(docs, labels, "toxic", fold(F.col("doc_id"), folds) != held, FIT_DOCS, FIT_TEXT_BYTES)
    model = docs.sparkSession.sparkContext.broadcast(fit(found["text"].combine_chunks(), found["label"].to_numpy() >= 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(data, ends))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
