"""Spelling variants: a positional q-gram index with a count filter finds the words one edit apart; forms and roots follow."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, chunks, parts, settle

#: Code points of a gram, of the shortest word, and edits.
Q, LEAST_LENGTH = 3, 7
#: Occurrences of a word, and times by which its form must be more frequent.
LEAST_COUNT, TIMES = 2, 10
#: One edit breaks Q grams at most, so two near words share one of their Q + 1 rarest.
PREFIX = Q + 1
#: Every MARK-th occurrence, by checksum, loses a code point.
MARK = 31
#: A run of letters that is long enough to matter; all of its code points are below 256.
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: Distinct words that a task holds before it hands their counts on, rows that it matches at once, and posting hits merged at once.
HELD, ROWS, HITS = 500_000, 200_000, 1 << 21
#: Indexed words of one posting list that a task holds; longer lists are dealt over several.
CROWD = 1 << 15


def worn(doc_id: str, run: str) -> str:
    """The run as this document spells it: where MARK divides the checksum of both, one code point is missing."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % MARK:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (word, n), summed over a task's documents as far as memory goes."""
    total: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch, data, ends in chunks(batches, "text"):
        low = data.tobytes().translate(LOWER_ASCII)
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            for run, n in Counter(RUN.findall(low[ends[i] : ends[i + 1]].decode())).items():
                word = worn(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    total[word] += n
        if len(total) >= HELD:
            yield flush()
    if total:
        yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, its word, its position) of all words in data, a byte a code point, in order."""
    code = data.astype(np.int32)
    at = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    gram = np.zeros(len(data), np.int32)
    for k in range(Q):
        gram[: len(data) - k] = gram[: len(data) - k] << 8 | code[k:]
    whole = at + Q <= np.repeat(np.diff(ends), np.diff(ends))
    return gram[whole], np.repeat(np.arange(len(ends) - 1), np.diff(ends))[whole], at[whole]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, ends in chunks(batches, "word"):
        kinds, n = np.unique(grams(data, ends)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["gram", "n"])


def key_of(gram: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The posting list of a gram at a position in words of a length; meetings by chance of huge words fail the count."""
    return gram.astype(np.int64) << 40 | (at.astype(np.int64) & 0xFFFFF) << 20 | (length.astype(np.int64) & 0xFFFFF)


def send_postings(batches: Iterator[pa.RecordBatch], known: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (key, shorter, word, n): each word's PREFIX rarest grams, as index entry and as probes of longer words."""
    for batch, data, ends in chunks(batches, "word"):
        gram, own, at = grams(data, ends)
        order = np.lexsort((at, rank[np.searchsorted(known, gram)], own))
        gram, own, at = gram[order], own[order], at[order]
        first = np.searchsorted(own, np.arange(len(ends) - 1))
        keep = np.arange(len(own)) - first[own] < PREFIX
        gram, own, at = gram[keep], own[keep], at[keep]
        length = np.diff(ends)[own]
        # a longer word has the gram at the same place if the edit is behind it, else one further on
        key = np.concatenate([key_of(gram, at, length), key_of(gram, at, length + 1), key_of(gram, at + 1, length + 1)])
        shorter = np.repeat([0, 1], [len(gram), 2 * len(gram)]).astype(np.int8)
        rows = pa.array(np.tile(own, 3))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(shorter), batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "shorter", "word", "n"])


PAIRS = pa.schema([("a", pa.binary()), ("a_n", pa.int64()), ("b", pa.binary()), ("b_n", pa.int64())])


class Rows:
    """Words of posting lists: a group each, a role (0 indexed and probing, 1 probing), and whether seen before."""

    def __init__(self, table: pa.Table, old: np.ndarray):
        column = lambda name: table[name].to_numpy()
        self.table, self.old = table, old
        key, tile = column("key"), column("tile")
        self.role, self.shorter = column("role"), column("shorter") == 1
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        self.group = np.cumsum(new) - 1
        word = table["word"].combine_chunks()
        buffers = word.buffers()
        self.ends = np.frombuffer(buffers[1], np.int32)[word.offset : word.offset + len(word) + 1].astype(np.int64)
        self.data = np.frombuffer(buffers[2], np.uint8)[self.ends[0] : self.ends[-1]]
        self.ends -= self.ends[0]
        self.length = np.diff(self.ends)
        # the gram by which the group meets is at this place of its indexed words
        self.place = key >> 20 & 0xFFFFF


def near(rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe, indexed) row pairs of a group that are one edit apart; of two equally long words the indexed one is smaller.

    Each probe's grams look up their posting lists in the group; the merged hits of a pair must reach the overlap bound.
    """
    indexed_row = (rows.role == 0) & ~rows.shorter
    meets = (np.bincount(rows.group, indexed_row) > 0) & (np.bincount(rows.group) > 1)
    gram, own, at = grams(rows.data, rows.ends)
    some = meets[rows.group[own]]
    gram, own, at = gram[some], own[some], at[some] & 0xFFFFF
    if not len(own):
        return
    # group, gram and place as one number: groups are fewer than rows, grams have 24 bits, places 20
    entry = rows.group[own].astype(np.int64) << 44 | gram.astype(np.int64) << 20 | at
    listed = indexed_row[own] & (at != rows.place[own])
    lists, ids = entry[listed], own[listed]
    order = np.argsort(lists, kind="stable")
    lists, ids = lists[order], ids[order]
    head = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.zeros(0, np.int64)
    if not len(head):
        return
    stop, names = np.r_[head[1:], len(ids)], lists[head]
    plus = np.flatnonzero(rows.shorter[own])
    wanted, asker = np.concatenate([entry, entry[plus] + 1]), np.concatenate([own, own[plus]])
    found = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    hit = np.flatnonzero(names[found] == wanted)
    hit = hit[np.argsort(asker[hit], kind="stable")]
    found, asker = found[hit], asker[hit]
    size = stop[found] - head[found]
    upto = np.cumsum(size)
    low = 0
    while low < len(asker):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + HITS, "right")))
        while high < len(asker) and asker[high] == asker[high - 1]:  # a probe's lists are merged together
            high += 1
        n = size[low:high]
        probe = np.repeat(asker[low:high], n)
        index = ids[np.repeat(head[found[low:high]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        fits = (rows.length[index] - rows.length[probe] == rows.shorter[probe]) & (probe != index) & ~(rows.old[probe] & rows.old[index])
        pair, count = np.unique(probe[fits] << 32 | index[fits], return_counts=True)
        probe, index = pair >> 32, pair & 0xFFFFFFFF
        # places repeat every 2**20 code points, where a hit one further on can be missed
        enough = count >= rows.length[index] - 2 * Q - (rows.length[index] >> 20)
        probe, index = probe[enough], index[enough]
        good = one_edit(rows, probe, index)
        yield probe[good], index[good]
        low = high


def one_edit(rows: Rows, probe: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Whether the words differ by exactly one replaced code point, or the indexed one has one more."""
    good = np.zeros(len(probe), bool)
    length = rows.length[probe]
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        step = max(1, (1 << 22) // int(size))
        for k in range(0, len(own), step):
            some = own[k : k + step]
            short = rows.shorter[probe[some]]
            a = rows.data[rows.ends[probe[some], None] + np.arange(size)]
            b = rows.data[rows.ends[index[some], None] + np.arange(size)]
            late = rows.data[rows.ends[index[some], None] + np.arange(size) + short[:, None]]
            same = (a == b).cumprod(1, dtype=np.int8).sum(1, dtype=np.int64) + (a == late)[:, ::-1].cumprod(1, dtype=np.int8).sum(1, dtype=np.int64)
            good[some] = np.where(short, same >= size, same == size - 1)
    # of two equally long words each pair is met from both sides; one is enough
    words = rows.table["word"].combine_chunks()
    even = good & ~rows.shorter[probe]
    if even.any():
        at = np.flatnonzero(even)
        good[at] = pa.compute.less(words.take(pa.array(index[at])), words.take(pa.array(probe[at]))).to_numpy(zero_copy_only=False)
    return good


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, tile, role) -> pairs of near words. Groups are matched many at once, and a long one in pieces.

    Of a group that goes on the indexed words are carried over: at most a tile of them.
    """

    def pairs(table: pa.Table, old: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = Rows(table, old)
        for probe, index in near(rows):
            if len(probe):
                a, b = (table.select(["word", "n"]).take(pa.array(x)).combine_chunks() for x in (probe, index))
                for batch in pa.Table.from_arrays([a["word"], a["n"], b["word"], b["n"]], schema=PAIRS).to_batches():
                    yield batch

    held, carried, n = [], None, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        table = pa.Table.from_batches(held)
        old = np.zeros(n, bool)
        if carried is not None:
            old = np.r_[np.ones(len(carried), bool), old]
            table = pa.concat_tables([carried, table])
        yield from pairs(table, old)
        last = table.slice(len(table) - 1)
        same = (table["key"].to_numpy() == last["key"][0].as_py()) & (table["tile"].to_numpy() == last["tile"][0].as_py()) & (table["role"].to_numpy() == 0) & (table["shorter"].to_numpy() == 0)
        carried, held, n = table.filter(pa.array(same)), [], 0
    if held:
        table, old = pa.Table.from_batches(held), np.zeros(n, bool)
        if carried is not None:
            table, old = pa.concat_tables([carried, table]), np.r_[np.ones(len(carried), bool), old]
        yield from pairs(table, old)


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two of the words (word, n) that are one inserted, deleted or replaced code point apart, once.

    Words are distinct and hold code points below 256 only. The table of gram counts has at most 90**3 rows, so it goes
    to all tasks. A posting list of more than CROWD words is dealt over tasks by hash, its probes go to each of them.
    """
    n = parts(words.sparkSession)
    bare = words.select(F.encode("word", "ISO-8859-1").alias("word"), "n")
    seen = bare.mapInArrow(count_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(seen["gram"].to_numpy())
    known, often = seen["gram"].to_numpy()[order], seen["n"].to_numpy()[order]
    rank = np.empty(len(known), np.int32)
    rank[np.lexsort((known, often))] = np.arange(len(known))
    shared = words.sparkSession.sparkContext.broadcast((known, rank))
    rows = settle(bare.mapInArrow(lambda it: send_postings(it, *shared.value), "key long, shorter byte, word binary, n long"), "postings")
    crowds = settle(rows.where("shorter = 0").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > CROWD), "crowds")
    tiles: Column = F.coalesce(F.ceil(F.col("size") / CROWD).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    dealt = rows.join(crowds, "key", "left").withColumn("tiles", tiles).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", "tile", F.when((F.col("shorter") == 0) & (F.col("tile") == own), 0).otherwise(1).cast("byte").alias("role"), "shorter", "word", "n")
    found = dealt.repartition(n, "key", "tile").sortWithinPartitions("key", "tile", "role").mapInArrow(match, "a binary, a_n long, b binary, b_n long").distinct()
    return found.select(F.decode("a", "ISO-8859-1").alias("a"), "a_n", F.decode("b", "ISO-8859-1").alias("b"), "b_n")


def rounds(most: int | None) -> int:
    """Doublings after which every chain of forms is followed to its end: each step is TIMES as frequent as the last."""
    steps = int(math.log(max(TIMES, most or 0) / LEAST_COUNT, TIMES)) + 1
    return math.ceil(math.log2(steps))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row a word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are the runs of Latin letters of at least LEAST_LENGTH code points, A-Z lower-cased, as worn() leaves them, that
    occur LEAST_COUNT times or more. form is the most frequent word one edit away (ties: the smallest in code points)
    if it is TIMES as frequent, root the last word reached by forms. Null and empty texts have no words; a null doc_id
    counts as an empty one; repeated rows count each; columns beside doc_id and text are not read.
    """
    words = settle(vocabulary(docs), "words")
    pairs = settle(near_words(words), "pairs")
    both = pairs.select("a", F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")).alias("near")).union(pairs.select("b", F.struct(-F.col("a_n"), F.col("a"))))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    rows = words.join(best, "word", "left").withColumn("fit", -F.col("near.n") >= TIMES * F.col("n"))
    rows = settle(rows.select("word", F.when(F.col("fit"), F.col("near.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fit"), -F.col("near.n")).alias("form_n")), "forms")
    chains = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(rounds(words.agg(F.max("n")).first()[0])):
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chains = settle(chains.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "chains")
    return rows.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
