"""Language identification by prediction by partial matching: code lengths under frozen byte-context statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold
from .textbytes import LETTER, LOWER

#: Fitting: about so many documents a language, chosen by hash.
FIT_DOCS = 600
#: Bytes of the longest context.
ORDER = 3
#: Of more languages than these the table of their cuts isn't broadcast.
BROADCAST_LANGS = 1 << 16


class Table:
    """Rows of 32-bit keys by open addressing; strangers have row -1."""

    def __init__(self, keys: np.ndarray):
        self.mask = np.uint32((4 << max(4, len(keys).bit_length())) - 1)
        self.key, self.row = np.zeros(int(self.mask) + 1, np.uint32), np.full(int(self.mask) + 1, -1, np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self.slots(keys)
        while len(todo):
            free = np.flatnonzero(self.row[slot[todo]] < 0)
            _, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free[first]]
            self.key[slot[placed]], self.row[slot[placed]] = keys[placed], placed
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint32(1)) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint32(0x9E3779B1)
        return (h ^ (h >> np.uint32(15))) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        out = self.row[slot]
        odd = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(odd):
            slot[odd] = (slot[odd] + np.uint32(1)) & self.mask
            out[odd] = self.row[slot[odd]]
            odd = odd[(out[odd] >= 0) & (self.key[slot[odd]] != keys[odd])]
        return out


@dataclass
class Level:
    """Contexts of `order` bytes. Costs in bits, a row a language; the last column is 0, for row -1."""

    order: int
    codes: np.ndarray  # context and byte, seen in some language
    contexts: np.ndarray
    costs: np.ndarray  # [languages, codes + 1], by this context or the next shorter one that knows the byte
    escapes: np.ndarray  # [languages, contexts + 1], 0 where the language has never seen the context


@dataclass
class Model:
    langs: list[str]
    levels: list[Level]  # from no context up

    def tables(self) -> list[tuple[Table, Table]]:
        if not hasattr(self, "_tables"):
            self._tables = [(Table(x.codes), Table(x.contexts)) for x in self.levels]
        return self._tables

    def __getstate__(self):
        return {"langs": self.langs, "levels": self.levels}


def codes_of(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each byte (A-Z lower-cased) behind its ORDER predecessors, packed, its own last; 0 stands before a text."""
    prior = LOWER[data].astype(np.uint32)
    code, starts = prior.copy(), ends[:-1][ends[:-1] < ends[1:]]
    for k in range(1, ORDER + 1):
        prior = np.r_[np.uint32(0), prior[:-1]]
        prior[starts] = 0
        code |= prior << np.uint32(8 * k)
    return code


def tail(codes: np.ndarray, order: int) -> np.ndarray:
    """What a context of `order` bytes sees of the codes."""
    return codes & np.uint32((1 << 8 * (order + 1)) - 1)


def grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, values, len(kinds)) if len(kinds) else np.zeros(0)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """From each language's codes and their counts. Escape by the number of distinct followers (method C), no exclusions.

    A byte that a context has seen c times in t, with k kinds of followers, has probability c / (t + k) there; any other
    escapes with k / (t + k) to the context shorter by a byte, a context never seen costs nothing, and below all stands
    one byte in 256.
    """
    langs = sorted(counts)
    levels: list[Level] = []
    for order in range(ORDER + 1):
        own = [grouped(tail(counts[x][0].astype(np.uint32), order), counts[x][1]) for x in langs]
        codes = np.unique(np.concatenate([k for k, _ in own])) if own else np.zeros(0, np.uint32)
        contexts = np.unique(codes >> np.uint32(8))
        costs, escapes = np.zeros((len(langs), len(codes) + 1), np.float32), np.zeros((len(langs), len(contexts) + 1), np.float32)
        for j, (keys, n) in enumerate(own):
            place = np.searchsorted(contexts, keys >> np.uint32(8))
            total, kinds = np.bincount(place, n, len(contexts)), np.bincount(place, minlength=len(contexts))
            seen = np.flatnonzero(kinds)
            escapes[j, seen] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
            below = np.full(len(codes), 8.0)
            if order:
                below = levels[-1].costs[j, np.searchsorted(levels[-1].codes, tail(codes, order - 1))]
            costs[j, :-1] = escapes[j, np.searchsorted(contexts, codes >> np.uint32(8))] + below
            costs[j, np.searchsorted(codes, keys)] = -np.log2(n / (total + kinds)[place])
        levels.append(Level(order, codes, contexts, costs, escapes))
    return Model(langs, levels)


def code_lengths(model: Model, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    code, at = codes_of(data, ends), np.arange(len(data))
    steps = []  # (bytes still open, rows of their codes, rows of the contexts of those that go on)
    for level, (known, contexts) in zip(reversed(model.levels), reversed(model.tables()), strict=True):
        row = known.find(tail(code[at], level.order))
        more = row < 0
        steps.append((level, at, row, at[more], contexts.find(tail(code[at[more]], level.order) >> np.uint32(8))))
        at = at[more]
    out = np.zeros((len(ends) - 1, len(model.langs)))
    for j in range(len(model.langs)):
        bits = np.zeros(len(code), np.float32)
        for level, here, row, on, context in steps:
            bits[here] += level.costs[j][row]
            bits[on] += level.escapes[j][context]
        bits[at] += 8
        total = np.zeros(len(bits) + 1)
        np.cumsum(bits, out=total[1:], dtype=np.float64)
        out[:, j] = total[ends[1:]] - total[ends[:-1]]
    return out


def predict(model: Model, texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language of least code length and its share of the languages' likelihood; `und` and 0 without a letter."""
    n = len(ends) - 1
    if not model.langs:
        return ["und"] * n, np.zeros(n)
    bits = code_lengths(model, data, ends)
    best = bits.argmin(1)
    share = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LETTER[data] & (data < 128), out=plain[1:])
    sure = plain[ends[1:]] > plain[ends[:-1]]
    for i in np.flatnonzero(~sure):
        sure[i] = bool(re.search(r"[^\W\d_]", texts[int(i)].as_py() or ""))
    return [model.langs[b] if s else "und" for b, s in zip(best, sure, strict=True)], np.where(sure, share, 0.0)


def cut_of(count: int) -> int:
    """63-bit hashes below it choose about FIT_DOCS of count documents, at any count."""
    return min((1 << 63) - 1, FIT_DOCS * (1 << 63) // count)


def count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, code, n)."""
    for batch, data, ends in chunks(batches, "text"):
        lang = batch.column(0).to_pylist()
        code = codes_of(data, ends)
        for x in sorted(set(lang)):
            mine = np.repeat(np.array([y == x for y in lang]), np.diff(ends))
            keys, n = np.unique(code[mine], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


def train(docs: DataFrame, rows) -> Model:
    """Fit on about FIT_DOCS whole documents a language among those where rows holds, chosen by hash of doc_id and text.

    The one of smallest hash is always among them, so a language with a row to learn from is learned, whatever its ids;
    repeated rows count once. The codes are counted where the sample lies; the driver gets a language's distinct codes,
    whose number the sample bounds. A language without such a row isn't in the model.
    """
    text = F.col("text").cast("string")
    known = docs.where(rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), text), 1).alias("h"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    share = [(r["lang"], max(r["least"], cut_of(r["n"]))) for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect()]
    if not share:
        return fit({})
    cuts = docs.sparkSession.createDataFrame(share, "lang string, cut long")
    picked = known.join(F.broadcast(cuts) if len(share) <= BROADCAST_LANGS else cuts, "lang").where("h <= cut").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    found = picked.mapInArrow(count_codes, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    for lang, _ in share:
        own = found.filter(pa.compute.equal(found["lang"], lang))
        if len(own):
            counts[lang] = (own["code"].to_numpy().astype(np.uint32), own["n"].to_numpy())
    return fit(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, lang_pred, score. Whole texts; null and letterless texts are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in chunks(batches, "text"):
            lang, score = predict(shared.value, batch.column(1), data, ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from documents outside the held-out fold and predict all; lang, source and doc_id are no inputs.

    A null doc_id has no fold: it is never learned from and isn't held out. Columns of docs beyond doc_id, text and lang
    are not read. An empty table gives no rows; where nothing can be learned from all are `und`. Equal rows agree.
    """
    model = train(docs, fold(F.col("doc_id"), folds) != held)
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
