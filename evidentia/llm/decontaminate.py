"""Benchmark decontamination: CGK walks over item-sized windows, bit samples of them as hash keys, exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_arrays
from .textbytes import LETTER, LOWER, Hasher, mixed, spans

#: A window is a leak if so much of the item's words survives: edit distance <= (1 - SIMILARITY) * words, in words.
SIMILARITY = 0.8
#: Bytes of item text broadcast at a time; more items go in further passes.
BLOCK_BYTES = 16 << 20
#: Items of fewer words than SHORT are found by pieces, of which one survives the one edit that they may have.
SHORT = 10
#: Random walks of a window, samples of each walk, and the steps of a sample: its bits lie near each other, since two
#: walks that are in step stay so for a while. With these 0.99 of the items are found at the most edits, at any length.
WALKS, SAMPLES, STEPS = 16, 4, (0, 4, 8)
#: Items are walked in classes of about equal length, and windows of a class begin at every (words / GRID)-th word.
RATIO, GRID = 1.1, 48
#: Windows walked at a time, and rows of the table of an edit distance.
AT_ONCE, ROWS = 1 << 15, 4096

TOKEN = LETTER.copy()
TOKEN[48:58] = True
FAR = np.int64(1 << 32)


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, A-Z lower-cased) and the n + 1 bounds of each text's words."""
    low = LOWER[data]
    start, stop = spans(TOKEN[low], ends)
    return Hasher(low)(start, stop), np.searchsorted(start, ends)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9FB21C651E98DF25) + b)


def allowed(n: int) -> int:
    """Word edits within which a window leaks an item of n words."""
    return int((1 - SIMILARITY) * n + 1e-9)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Key of the size words from each word on."""
    key = words
    for i in range(1, size):
        key = pair(key[:-1], words[i:])
    return key


class Keys:
    """A multimap from 64-bit keys to rows, with a bitmap that turns most strangers away."""

    def __init__(self, key: np.ndarray):
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.low = np.uint64((1 << max(16, 3 + int(len(key)).bit_length())) - 1)
        self.map = np.zeros(int(self.low) + 1, bool)
        self.map[key & self.low] = True

    def maybe(self, key: np.ndarray) -> np.ndarray:
        return self.map[key & self.low]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in key, row) of every match."""
        at = np.flatnonzero(self.maybe(key))
        lo, hi = np.searchsorted(self.key, key[at], "left"), np.searchsorted(self.key, key[at], "right")
        n = hi - lo
        return np.repeat(at, n), self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


@dataclass
class Class:
    """Items of `least` to `most` words, which are walked with the same coins."""

    least: int
    most: int
    grams: Keys  # of three words; a leak keeps `kept` of them at least
    samples: np.ndarray  # [WALKS, SAMPLES] first steps
    keys: Keys
    item: np.ndarray  # of each key

    @property
    def kept(self) -> int:
        return min(n - 2 - 3 * allowed(n) for n in range(self.least, self.most + 1))


def samples_of(least: int) -> np.ndarray:
    """First steps of the samples, over the steps in which a walk passes `least` words."""
    return np.sort(np.random.default_rng(least).integers(0, max(1, 2 * least - STEPS[-1]), (WALKS, SAMPLES)), axis=1)


def walk(words: np.ndarray, start: np.ndarray, stop: np.ndarray, samples: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """[windows, SAMPLES] keys of one random walk from start, and which of them lie before stop.

    CGK's embedding: at every step the window shows the word that it is at, and goes on by a coin that step and word
    decide, the same for all windows. Few edits leave two windows in step, or bring them back in step, on most of the
    way, so edit distance becomes Hamming distance; a sample is the words shown at a few steps.
    """
    at = start.copy()
    words = np.append(words, np.uint64(0))
    shown = {}
    wanted = {int(s) + d for s in samples for d in STEPS}
    for step in range(max(wanted) + 1):
        word = words[np.where(at < stop, at, -1)]
        if step in wanted:
            shown[step] = word
        coin = mixed(np.array([(which << 32) + step], np.uint64)) | np.uint64(1)
        at += ((word * coin) >> np.uint64(63)).astype(np.int64)
    out, whole = np.zeros((len(start), len(samples)), np.uint64), np.ones((len(start), len(samples)), bool)
    for j, s in enumerate(samples):
        key = np.full(len(start), np.uint64((which << 32) + (j << 24) + 1))
        for d in STEPS:
            key = pair(key, shown[int(s) + d])
            whole[:, j] &= shown[int(s) + d] != 0
        out[:, j] = key
    return out, whole


class Index:
    """Items of one block: short ones by their pieces, the others by classes of length."""

    def __init__(self, ids: list[int], texts: pa.Array):
        words, bound = tokens(*text_arrays(texts))
        own = [words[bound[i] : bound[i + 1]] for i in range(len(ids))]
        keep = [i for i, w in enumerate(own) if len(w)]
        self.ids, self.items = np.array([ids[i] for i in keep], np.int64), [own[i] for i in keep]
        self.pieces = self.short_pieces()
        self.classes = []
        sizes = sorted({len(w) for w in self.items if len(w) >= SHORT})
        while sizes:
            least = sizes[0]
            most = max(n for n in sizes if n <= least * RATIO)
            self.classes.append(self.longer(least, most))
            sizes = [n for n in sizes if n > most]

    def short_pieces(self) -> list[tuple[int, Keys, np.ndarray, np.ndarray]]:
        """(words, keys, item, where in it) of the pieces of short items, one more than the edits allowed."""
        cut: dict[int, list[tuple[np.uint64, int, int]]] = {}
        for i, w in enumerate(self.items):
            n, m = len(w), allowed(len(w)) + 1
            if n < SHORT:
                edges = [k * n // m for k in range(m + 1)]
                for a, b in zip(edges, edges[1:], strict=False):
                    cut.setdefault(b - a, []).append((grams(w[a:b], b - a)[0], i, a))
        return [(size, Keys(np.array([r[0] for r in rows], np.uint64)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) for size, rows in sorted(cut.items())]

    def longer(self, least: int, most: int) -> Class:
        mine = [i for i, w in enumerate(self.items) if least <= len(w) <= most]
        words = np.concatenate([self.items[i] for i in mine])
        stop = np.cumsum([len(self.items[i]) for i in mine])
        start = np.r_[0, stop[:-1]]
        threes = np.concatenate([grams(self.items[i], 3) for i in mine])
        samples, key, item = samples_of(least), [], []
        for which in range(WALKS):
            got, whole = walk(words, start, stop, samples[which], which)
            key.append(got[whole])
            item.append(np.broadcast_to(np.array(mine)[:, None], whole.shape)[whole])
        return Class(least, most, Keys(threes), samples, Keys(np.concatenate(key)), np.concatenate(item))

    def candidates(self, words: np.ndarray, bounds: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, word where it would begin)."""
        for size, keys, item, offset in self.pieces:
            if len(words) >= size:
                at, row = keys.find(grams(words, size))
                yield item[row], at - offset[row]
        threes = grams(words, 3) if len(words) >= 3 else words[:0]
        for c in self.classes:
            if not len(threes):
                continue
            # a leak keeps so many of an item's three-word grams that most windows need no walk
            total = np.zeros(len(words) + 1, np.int64)
            np.cumsum(c.grams.maybe(threes), out=total[1 : len(threes) + 1])
            total[len(threes) + 1 :] = total[len(threes)]
            reach = c.most + allowed(c.most)
            start = np.arange(0, len(words), max(1, c.least // GRID))
            stop = np.minimum(start + reach, bounds[text[start] + 1])
            start = start[total[np.maximum(start, stop - 2)] - total[start] >= max(1, c.kept)]
            for i in range(0, len(start), AT_ONCE):
                s = start[i : i + AT_ONCE]
                end = np.minimum(s + reach, bounds[text[s] + 1])
                for which in range(WALKS):
                    key, whole = walk(words, s, end, c.samples[which], which)
                    for j in range(SAMPLES):
                        at = np.flatnonzero(whole[:, j])
                        place, row = c.keys.find(key[at, j])
                        yield c.item[row], s[at[place]]

    def leaks(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, start, stop, distance): the nearest window of each text and item that is near enough."""
        words, bounds = tokens(data, ends)
        empty = tuple(np.zeros(0, np.int64) for _ in range(5))
        text_of = np.repeat(np.arange(len(ends) - 1), np.diff(bounds))
        got = list(self.candidates(words, bounds, text_of)) if len(words) else []
        if not sum(len(i) for i, _ in got):
            return empty
        item, begin = (np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True))
        begin = np.clip(begin, 0, len(words) - 1)  # pieces at a text's edge
        edits = np.array([allowed(len(w)) for w in self.items], np.int64)[item]
        rows = np.unique(np.stack([item, text_of[begin], begin // (edits + 1) * (edits + 1)], 1), axis=0)
        out = []
        for mine in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
            i = int(mine[0, 0])
            step = max(1, ROWS * 64 // (len(self.items[i]) + 64))
            for a in range(0, len(mine), step):
                out.append(self.verify(i, mine[a : a + step], words, bounds))
        found = np.concatenate(out)
        if not len(found):
            return empty
        found = found[np.lexsort((found[:, 2], found[:, 4], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        return tuple(found[first].T)

    def verify(self, i: int, rows: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (text, item, start, stop, distance) of the candidates whose best window, anywhere around, is a leak.

        One dynamic programme for all candidates: cells hold distance * FAR + where the window starts.
        """
        item = self.items[i]
        most = allowed(len(item))
        text, begin = rows[:, 1], rows[:, 2] - 2 * most - 1
        width = len(item) + 5 * most + 3
        place = begin[:, None] + np.arange(width)
        inside = (place >= bounds[text][:, None]) & (place < bounds[text + 1][:, None])
        near = np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))
        # a leak keeps all but `most` of the item's words
        table = np.zeros(1 << 16, bool)
        table[item & np.uint64(0xFFFF)] = True
        may = table[near & np.uint64(0xFFFF)].sum(1) >= len(item) - most
        text, begin, near = text[may], begin[may], near[may]
        if not len(text):
            return np.zeros((0, 5), np.int64)
        columns = np.arange(width + 1)
        cell = np.broadcast_to(columns, (len(text), width + 1)).astype(np.int64)
        for w in item:
            new = cell + FAR
            new[:, 1:] = np.minimum(new[:, 1:], cell[:, :-1] + np.where(near == w, 0, FAR))
            cell = np.minimum.accumulate(new - columns * FAR, axis=1) + columns * FAR
        stop = cell.argmin(1)
        best = cell[np.arange(len(text)), stop]
        distance, start = best // FAR, best % FAR
        good = distance <= most
        base = begin - bounds[text]
        return np.stack([text, np.full(len(text), i), base + start, base + stop, distance], 1)[good]


def indexes(items: DataFrame) -> Iterator:
    """Broadcast indexes of the items, BLOCK_BYTES of text each."""
    items = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        yield items.sparkSession.sparkContext.broadcast(Index(block["item_id"].to_pylist(), block["text"].combine_chunks()))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, all columns, without the documents in which an item occurs. Rows are judged where they lie: nothing is shuffled.

    Null and empty texts stay, as do all rows if there is no item with a word; equal rows go or stay together. Null
    doc_ids are judged like any other, and no column but text is read.
    """
    for shared in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, data, ends in chunks(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[shared.value.leaks(data, ends)[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document and benchmark item whose words occur in it with few edits: doc_id, item_id, start_word, stop_word, distance, n_words.

    Words are runs of letters and digits, A-Z lower-cased; a window leaks an item of n words within floor(0.2 n) word edits.
    Items are the query set: they go in blocks of BLOCK_BYTES, each against every whole document, and only a block is
    broadcast. Items and texts without words, null ones too, match nothing; a null doc_id or item_id is kept as it is (items: -1).
    Every leak of an item of fewer than SHORT words is found; of longer ones that hold the most edits about 0.99 or more,
    and nearly all with fewer. What is reported is verified exactly. Equal items are found each; of several windows the
    nearest, then the first, is reported. Memory grows with an item's length, not with the number of candidates.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, start_word long, stop_word long, distance long, n_words long"
    out = None
    for shared in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, data, ends in chunks(batches, "text"):
                text, item, start, stop, distance = index.leaks(data, ends)
                size = np.array([len(index.items[i]) for i in item], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(index.ids[item] if len(item) else item), pa.array(start), pa.array(stop), pa.array(distance), pa.array(size)], ["doc_id", "item_id", "start_word", "stop_word", "distance", "n_words"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
