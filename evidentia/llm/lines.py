"""Quality classifier: a linear-chain conditional random field over lines, aggregated into a document score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, text_arrays
from .textbytes import LOWER, SPACE, Hasher, owner, spans, sums

#: Labelled documents that the field is fitted on at most (of smallest hash), none longer than so many bytes.
FIT_DOCS, FIT_TEXT_BYTES = 4000, 1 << 16
STEPS, RATE, DECAY = 120, 0.1, 1e-3
#: Texts of more lines go by blocks of so many lines.
LONG, BLOCK = 4096, 512

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=+@_/"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:?"]] = True
NAMES = ("symbols", "upper", "digits", "shouts", "stops", "bars", "word_length", "few_words", "long_line", "same_word", "distinct", "seen_before")


@dataclass
class Lines:
    """Lines that hold a word, and one empty line for a text without any."""

    ends: np.ndarray  # lines of each text
    weight: np.ndarray  # bytes
    own: np.ndarray  # [lines, NAMES]


def lines_of(data: np.ndarray, ends: np.ndarray) -> Lines:
    n = len(ends) - 1
    start, stop = spans(data != 10, ends)
    w_start, w_stop = spans(~SPACE[data], ends)
    if len(w_start):
        bounds = np.searchsorted(w_start, np.r_[start, len(data)])
        keep = np.diff(bounds) > 0
        start, stop, w_from, w_to = start[keep], stop[keep], bounds[:-1][keep], bounds[1:][keep]
    else:
        start = stop = w_from = w_to = np.zeros(0, np.int64)
    text = owner(ends, start)
    blank = np.setdiff1d(np.arange(n), text)
    hashes = Hasher(LOWER[data])
    count = lambda table: sums_at(table[data], start, stop)
    size = np.maximum(stop - start, 1)
    words = np.maximum(w_to - w_from, 1)
    w_hash = hashes(w_start, w_stop)
    again = np.zeros(len(w_hash), bool)
    again[1:] = w_hash[1:] == w_hash[:-1]
    line_of_word = np.repeat(np.arange(len(start)), w_to - w_from)
    pair = np.lexsort((w_hash, line_of_word))
    first = np.ones(len(pair), bool)
    first[1:] = (w_hash[pair][1:] != w_hash[pair][:-1]) | (line_of_word[pair][1:] != line_of_word[pair][:-1])
    distinct = np.bincount(line_of_word[pair], first, len(start)) if len(pair) else np.zeros(len(start))
    l_hash = hashes(start, stop)
    by = np.lexsort((start, l_hash, text))
    repeat = np.zeros(len(start), bool)
    repeat[by[1:]] = (l_hash[by][1:] == l_hash[by][:-1]) & (text[by][1:] == text[by][:-1])
    shout = np.zeros(256, bool)
    shout[33] = True
    bar = np.zeros(256, bool)
    bar[124] = True
    letters = size - count(SPACE)
    own = np.stack(
        [
            count(SYMBOL) / size,
            count(UPPER) / size,
            count(DIGIT) / size,
            np.minimum(count(shout) / words, 2),
            np.minimum(count(STOP) / words, 2),
            np.minimum(count(bar) / words, 2),
            np.minimum(letters / words, 30) / 10,
            words < 4,
            np.log1p(words) / 5,
            sums_at(again, w_from, w_to) / words,
            distinct / words,
            repeat,
        ],
        axis=1,
    ).astype(np.float64) if len(start) else np.zeros((0, len(NAMES)))
    order = np.argsort(np.r_[text, blank], kind="stable")
    return Lines(np.r_[0, np.cumsum(np.bincount(np.r_[text, blank], minlength=n))].astype(np.int64), np.r_[size.astype(float) if len(start) else np.zeros(0), np.ones(len(blank))][order], np.vstack([own, np.zeros((len(blank), len(NAMES)))])[order])


def sums_at(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[stop] - total[start]


def inputs(x: Lines, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A line's own measures, those of the lines before and after, whether it is first or last, and a constant."""
    own = (x.own - mean) / scale
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first, last = np.zeros(len(own)), np.zeros(len(own))
    some = x.ends[:-1] < x.ends[1:]
    head, tail = x.ends[:-1][some], x.ends[1:][some] - 1
    first[head], last[tail] = 1, 1
    before[head], after[tail] = 0, 0
    return np.column_stack([own, before, after, first, last, np.ones(len(own))])


def marginals(unary: np.ndarray, trans: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and for each line but a text's first the 2 x 2 of it and the one before (else zeros).

    Forward-backward over all texts at once, longest first, so that step t touches only the texts with a line t. Texts of
    over LONG lines go by blocks(), in far fewer steps than they have lines.
    """
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG, "left"))
    base, size = ends[:-1][order], size[order]
    psi = np.stack([np.zeros(len(unary)), unary], 1)
    e = np.exp(psi - psi.max(1, keepdims=True)) if len(psi) else psi
    t = np.exp(trans - trans.max())
    forward, backward = np.zeros_like(e), np.ones_like(e)
    for at, n in zip(base[:long].tolist(), size[:long].tolist(), strict=True):
        forward[at : at + n], backward[at : at + n] = blocks(e[at : at + n], t)
    rest, size = base[long:], size[long:]
    longest = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -k, "left")) for k in range(longest)]  # texts with more than k lines
    for k in range(longest):
        at = rest[: live[k]] + k
        f = e[at] if k == 0 else (forward[at - 1] @ t) * e[at]
        forward[at] = f / f.sum(1, keepdims=True)
    for k in range(longest - 1, 0, -1):
        at = rest[: live[k]] + k
        b = (e[at] * backward[at]) @ t.T
        backward[at - 1] = b / b.sum(1, keepdims=True)
    both = np.zeros((len(e), 2, 2))
    inner = np.ones(len(e), bool)
    inner[ends[:-1][ends[:-1] < ends[1:]]] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] * t[None] * (e[at] * backward[at])[:, None, :]
    both[at] = pair / pair.sum((1, 2), keepdims=True)
    good = forward * backward
    return good[:, 1] / good.sum(1), both


def blocks(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors of one long text, up to a factor a line.

    A step is a product with a 2 x 2 matrix. The products within all blocks of BLOCK lines are taken side by side, then
    carried from block to block: BLOCK steps and one a block, instead of one a line.
    """
    n = len(e)
    count = -(-n // BLOCK)
    step = np.tile(np.eye(2), (count * BLOCK, 1, 1))
    step[1:n] = t[None] * e[1:, None, :]
    step = step.reshape(count, BLOCK, 2, 2)
    unit = lambda m, axes: m / m.max(axes, keepdims=True)
    after, before = step.copy(), step.copy()  # products from a block's start to a line, and from a line to its end
    for k in range(1, BLOCK):
        after[:, k] = unit(after[:, k - 1] @ step[:, k], (1, 2))
        before[:, -k - 1] = unit(step[:, -k - 1] @ before[:, -k], (1, 2))
    come, go = np.zeros((count, 2)), np.zeros((count, 2))
    come[0], go[-1] = e[0], 1
    for k in range(1, count):
        come[k] = unit(come[k - 1] @ after[k - 1, -1], 0)
        go[-k - 1] = unit(before[-k, 0] @ go[-k], 0)
    forward = np.einsum("bi,bkij->bkj", come, after).reshape(-1, 2)[:n]
    backward = np.ones((count * BLOCK + 1, 2))
    backward[:-1] = np.einsum("bkij,bj->bki", before, go).reshape(-1, 2)
    return unit(forward, 1), unit(backward[1 : n + 1], 1)


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float


def share(x: Lines, good: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' P(good), as log odds."""
    p = sums(good * x.weight, x.ends) / np.maximum(sums(x.weight, x.ends), 1e-9)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(texts: pa.Array, good: np.ndarray) -> Field:
    """Maximum likelihood with line labels that start as the document's and, in bad documents, are estimated once.

    Only documents are labelled: after half the steps a bad document's lines that look surely good are relabelled good.
    A logistic curve from the aggregated log odds to the document's label is fitted last.
    """
    data, ends = text_arrays(texts)
    x = lines_of(data, ends)
    k = len(NAMES)
    if not len(texts) or good.min() == good.max():
        p = (good.sum() + 1) / (len(good) + 2) if len(good) else 0.5
        return Field(np.zeros(k), np.ones(k), np.zeros(3 * k + 3), np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p))))
    mean, scale = x.own.mean(0), x.own.std(0) + 1e-6
    z = inputs(x, mean, scale)
    label = np.repeat(good, np.diff(x.ends)).astype(float)
    bad = label == 0
    inner = np.ones(len(z), bool)
    inner[x.ends[:-1]] = False
    at = np.flatnonzero(inner)
    # each class of documents has the same weight, so that rare bad lines are learned
    cost = np.where(np.repeat(good, np.diff(x.ends)), 0.5 / bad[~bad].size, 0.5 / max(1, bad.sum())) * len(z)
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, STEPS + 1):
        p, both = marginals(z @ w, trans, x.ends)
        if step == STEPS // 2:
            label[bad & (p > 0.8)] = 1
        g = z.T @ (cost * (label - p)) / len(z) - DECAY * w
        y = label.astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), cost[at])
        gt = (seen - (both * cost[:, None, None]).sum(0)) / len(z) - DECAY * trans
        full = np.r_[g, gt.ravel()]
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    s = share(x, marginals(z @ w, trans, x.ends)[0])
    slope, offset = logistic(s, good.astype(float))
    return Field(mean, scale, w, trans, slope, offset)


def logistic(s: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        r = p * (1 - p)
        g = np.array([((y - p) * s).sum() - 1e-2 * a, (y - p).sum()])
        h = np.array([[(r * s * s).sum() + 1e-2, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    return float(a), float(b)


def score(f: Field, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    x = lines_of(data, ends)
    good, _ = marginals(inputs(x, f.mean, f.scale) @ f.weights, f.trans, x.ends)
    return 1 / (1 + np.exp(-np.clip(f.slope * share(x, good) + f.offset, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows, limit: int, longest: int) -> pa.Table:
    """(text, label) of at most limit documents for which rows holds, those of smallest hash; the larger of two labels."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & rows).groupBy("doc_id").agg(F.max(column).alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    return own.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).orderBy("doc_id", "text").select("text", "label").toArrow()


def line_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Labels of the held-out fold are never read for fitting.

    Null, empty and wordless texts are one empty line and get the score that such a line earns. Without usable labels
    every score is the base rate (0.5 if there are none). A null doc_id isn't held out. Other columns of docs are not read.
    """
    found = labelled(docs, labels, "quality", fold(F.col("doc_id"), folds) != held, FIT_DOCS, FIT_TEXT_BYTES)
    model = docs.sparkSession.sparkContext.broadcast(fit(found["text"].combine_chunks(), found["label"].to_numpy() >= 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(model.value, data, ends))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
