"""Exact repeats of byte strings: suffixes sorted bucket by bucket under a cover of sampled positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, parts, settle
from .textbytes import Hasher, mixed, owner

#: Bytes of the k-gram at a sampled position, and records that a task gathers before it sends them on.
GRAM, FLUSH = 24, 1_000_000
NO_ID = -(1 << 63)
#: More representatives of a gram than these are a crowd, whose strings are dealt over all tasks.
CROWD = 1 << 14
#: A row is a document of its own, told apart by `row`, a hash of doc_id and text; `doc`, its doc_id, only orders.
RECORD = np.dtype([("gram", "u8"), ("context", "u8"), ("doc", "i8"), ("row", "i8"), ("start", "u4"), ("windows", "u1"), ("offset", "u1")])
RANGE = pa.schema([("kind", pa.int8()), ("bucket", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("blob", pa.binary())])
RANGE_DDL = "kind tinyint, bucket long, doc long, row long, start long, stop long, blob binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def cover(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
    """RECORDs of the sampled positions: of the k-grams in each string of `length` bytes the one of least hash.

    Equal strings sample the same place in themselves, wherever they stand: what a difference cover gives for two
    positions, at 2.5 % of the positions. A record stands for the run of strings that share a sample; `context` is the
    hash of all their bytes, `offset` the place of the sample behind the first one's start.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, RECORD)
    h = Hasher(data)
    at = np.arange(n - GRAM + 1)
    grams = h(at, at + GRAM)
    bits = np.uint64(max(24, n.bit_length()))
    least = sliding_min((grams >> bits << bits) | at.astype(np.uint64), length - GRAM + 1)
    sample = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    del least
    valid = np.zeros(len(sample), bool)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        valid[a : max(a, b - length + 1)] = True
    new = valid.copy()
    text_start = np.zeros(n + 1, bool)
    text_start[ends] = True
    new[1:] &= (sample[1:] != sample[:-1]) | ~valid[:-1] | text_start[1 : len(sample)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(sample)) - 1
    # a run ends with its text's last string, too
    own = owner(ends, first)
    last = np.minimum(last, ends[own + 1] - length)
    out = np.zeros(len(first), RECORD)
    out["gram"], out["context"] = grams[sample[first]], h(first, last + length)
    out["doc"], out["row"], out["start"], out["windows"], out["offset"] = doc[own], row[own], first - ends[own], last - first + 1, sample[first] - first
    return out


def by_context(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records in order of (gram, context, doc, row, start), which also start earlier, and which stand for the rest.

    Earlier is a smaller doc_id, or an earlier start in the same row; of rows with one doc_id none is earlier. What is
    not later itself stands for its context: one record, or one a row where several rows have the smallest doc_id.
    """
    r = r[np.lexsort((r["start"], r["row"], r["doc"], r["context"], r["gram"]))]
    if not len(r):
        return r, np.zeros(0, bool), np.zeros(0, bool)
    later, same_place = later_than(r["doc"], r["row"], r["start"], changed(r["gram"], r["context"]))
    return r, later, ~later & ~same_place


def changed(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def later_than(doc: np.ndarray, row: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs (their first given) in order of (doc, row, start): which are later than another, and which repeat the place before."""
    n = np.arange(len(doc))
    lead = np.maximum.accumulate(np.where(first, n, 0))
    head = first.copy()
    head[1:] |= (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
    own = np.maximum.accumulate(np.where(head, n, 0))
    repeat = ~head
    repeat[1:] &= start[1:] == start[:-1]
    return (doc != doc[lead]) | (start != start[own]), repeat


def ranges(r: np.ndarray, length: int) -> pa.RecordBatch:
    """The records' bytes, those that touch merged."""
    r = r[np.lexsort((r["start"], r["row"], r["doc"]))]
    start = r["start"].astype(np.int64)
    stop = start + r["windows"] + (length - 1)
    new = np.ones(len(r), bool)
    if len(r) > 1:
        new[1:] = (r["row"][1:] != r["row"][:-1]) | (r["doc"][1:] != r["doc"][:-1]) | (start[1:] > stop[:-1])
    edge = np.flatnonzero(new)
    stops = np.maximum.reduceat(stop, edge) if len(r) else stop
    row = r["row"][edge]
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(edge), np.int8)), pa.array(row), pa.array(r["doc"][edge]), pa.array(row), pa.array(start[edge]), pa.array(stops), pa.nulls(len(edge), pa.binary())], schema=RANGE)


def sample_texts(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc, row, text) -> the records by bucket, and ranges for contexts that a task has itself seen earlier."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        r, later, keep = by_context(np.concatenate(held))
        held.clear()
        yield ranges(r[later], length)
        keep = r[keep]
        bucket = (keep["gram"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = [b"".join(keep[f][a:b].tobytes() for f in RECORD.names) for a, b in zip(edge, np.r_[edge[1:], len(keep)], strict=True)]
        n = len(edge)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(bucket[edge]), *[pa.nulls(n, pa.int64())] * 4, pa.array(blobs, pa.binary())], schema=RANGE)

    for batch, data, ends in chunks(batches, "text"):
        r = cover(data, ends, batch.column(0).to_numpy(), batch.column(1).to_numpy(), length)
        if len(r):
            held.append(r)
        if sum(map(len, held)) >= FLUSH:
            yield from flush()
    if held:
        yield from flush()


def unpack(blob: bytes) -> np.ndarray:
    n, at = len(blob) // RECORD.itemsize, 0
    out = np.zeros(n, RECORD)
    for f in RECORD.names:
        size = n * RECORD[f].itemsize
        out[f] = np.frombuffer(blob[at : at + size], RECORD[f])
        at += size
    return out


def match_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> ranges (kind 1), and for grams with several contexts what stands for each (kind 2, or 3 where they are a crowd)."""

    def match(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        r, later, keep = by_context(np.concatenate([unpack(b) for b in blobs]))
        yield ranges(r[later], length)
        reps = r[keep]
        if len(reps) < 2:
            return
        edge = np.flatnonzero(changed(reps["gram"]))
        size = np.diff(np.r_[edge, len(reps)])
        contexts = np.add.reduceat(changed(reps["gram"], reps["context"]).astype(np.int64), edge)
        reps, size = reps[np.repeat(contexts > 1, size)], np.repeat(size, size)[np.repeat(contexts > 1, size)]
        n = len(reps)
        # for a representative: bucket holds its gram, start and stop its first string and the last one's end
        start = reps["start"].astype(np.int64)
        place = reps["offset"].tobytes()
        kind = np.where(size > CROWD, 3, 2).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(reps["gram"].copy().view(np.int64)), pa.array(reps["doc"]), pa.array(reps["row"]), pa.array(start), pa.array(start + reps["windows"] + (length - 1)), pa.array([place[i : i + 1] for i in range(n)], pa.binary())], schema=RANGE)

    held: list[bytes] = []
    bucket = None
    for batch in batches:
        kind = batch.column(0).to_numpy()
        passed = batch.filter(pa.array(kind == 1))
        if passed.num_rows:
            yield passed
        rest = batch.filter(pa.array(kind == 0))
        for b, blob in zip(rest.column(1).to_pylist(), rest.column(6).to_pylist(), strict=True):
            if b != bucket and held:
                yield from match(held)
                held = []
            bucket = b
            held.append(blob)
    if held:
        yield from match(held)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, text, reps) -> one row a representative with its bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            out: list[list] = [[] for _ in CONTEXT]
            for x in batch.slice(i, 256).to_pylist():
                for rep in x["reps"]:
                    for column, v in zip(out, (rep["kind"], rep["bucket"], x["doc"], x["row"], rep["start"], rep["blob"][0], (x["text"] or b"")[rep["start"] : rep["stop"]]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, CONTEXT.types, strict=True)], schema=CONTEXT)


CONTEXT = pa.schema([("kind", pa.int8()), ("gram", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("offset", pa.int64()), ("body", pa.binary())])
CONTEXT_DDL = "kind tinyint, gram long, doc long, row long, start long, offset long, body binary"
STRING_DDL = "string long, doc long, row long, start long, later boolean"


def strings(gram, offset, body, length: int) -> tuple[np.ndarray, ...]:
    """All strings of the representatives: which one's, how far behind its start, place of the sample, hash."""
    size = np.array([len(b) for b in body], np.int64)
    data = np.frombuffer(b"".join(body), np.uint8)
    base = np.cumsum(size) - size
    windows = np.maximum(size - length + 1, 0)
    of = np.repeat(np.arange(len(size)), windows)
    k = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    return of, k, (offset[of] - k).astype(np.int64), Hasher(data)(base[of] + k, base[of] + k + length)


def crowd_strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Representatives of crowded grams -> a row a string, named by one hash, so that no task gets a crowd whole.

    Of a string that a batch holds often only what is earliest goes on; the others are known to be later already.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            b = batch.slice(i, 4096)
            gram, doc, row, start, offset = (b.column(c).to_numpy() for c in range(1, 6))
            of, k, key, h = strings(gram, offset, b.column(6).to_pylist(), length)
            name, place = mixed(h + mixed(gram[of].copy().view(np.uint64) + key.astype(np.uint64))), start[of] + k
            order = np.lexsort((place, row[of], doc[of], name))
            o, name, place = of[order], name[order], place[order]
            later, repeat = later_than(doc[o], row[o], place, changed(name)) if len(o) else (np.zeros(0, bool),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(x[~repeat]) for x in (name.view(np.int64), doc[o], row[o], place, later)], ["string", "doc", "row", "start", "later"])


def match_contexts(batches: Iterator[pa.RecordBatch], length: int, at_once: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Representatives sorted by gram -> ranges of their strings that also start earlier in another one.

    The strings of a gram's bucket are sorted by (gram, place of the sample, bytes); runs of equals lose all but the
    earliest. Whole buckets at a time.
    """

    def emit(gram, doc, row, start, offset, body) -> pa.RecordBatch:
        of, k, key, h = strings(gram, offset, body, length)
        place = start[of] + k
        order = np.lexsort((place, row[of], doc[of], h, key, gram[of]))
        o = of[order]
        r = np.zeros(0, RECORD)
        if len(order):
            later, _ = later_than(doc[o], row[o], place[order], changed(gram[o], key[order], h[order]))
            hit = order[later]
            r = np.zeros(len(hit), RECORD)
            r["doc"], r["row"], r["start"], r["windows"] = doc[of[hit]], row[of[hit]], place[hit], 1
        return ranges(r, length)

    held: list[list] = []
    n = 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(1, 6)] + [batch.column(6).to_pylist()])
        n += batch.num_rows
        if n >= at_once:
            gram, doc, row, start, offset = (np.concatenate([x[i] for x in held]) for i in range(5))
            body = [b for x in held for b in x[5]]
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield emit(gram[:cut], doc[:cut], row[:cut], start[:cut], offset[:cut], body[:cut])
            held, n = [[gram[cut:], doc[cut:], row[cut:], start[cut:], offset[cut:], body[cut:]]], len(gram) - cut
    if n:
        yield emit(*(np.concatenate([x[i] for x in held]) for i in range(5)), [b for x in held for b in x[5]])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, gone) -> the counts and the digest of what is left."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            rows = []
            for x in batch.slice(i, 512).to_pylist():
                text, at, spans, removed, keep = x["text"] or b"", 0, 0, 0, hashlib.sha256()
                end = -1
                for g in sorted(x["gone"] or [], key=lambda g: (g["start"], g["stop"])):
                    if g["start"] > end:
                        spans += 1
                        keep.update(text[at : g["start"]])
                        removed += g["stop"] - g["start"]
                        at = end = g["stop"]
                    elif g["stop"] > end:
                        removed += g["stop"] - end
                        at = end = g["stop"]
                keep.update(text[at:])
                rows.append({"doc_id": x["doc_id"], "n_bytes": len(text), "n_removed": removed, "n_spans": spans, "kept_sha256": keep.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, OUT)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, row, text as bytes): null ids come first; equal rows with an id are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """(row, start, stop): byte ranges whose strings of `length` bytes also start earlier; they may overlap."""
    spark = docs.sparkSession
    n = parts(spark)
    texts = rows_of(docs).drop("doc_id")
    sampled = texts.mapInArrow(lambda it: sample_texts(it, length, 8 * n), RANGE_DDL)
    found = settle(sampled.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(lambda it: match_buckets(it, length), RANGE_DDL), "matched")
    reps = found.where("kind > 1").groupBy("row").agg(F.collect_set(F.struct("kind", "bucket", "start", "stop", "blob")).alias("reps"))
    bytes_of = texts.join(reps, "row").select("doc", "row", "text", "reps").mapInArrow(contexts, CONTEXT_DDL)
    bytes_of = settle(bytes_of, "contexts")
    few = bytes_of.where("kind = 2").repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(lambda it: match_contexts(it, length), RANGE_DDL)
    columns = ["row", "start", "stop"]
    # a crowd's strings are dealt each for itself, and what is earliest of one is found by combined minima
    crowd = settle(bytes_of.where("kind = 3").mapInArrow(lambda it: crowd_strings(it, length), STRING_DDL), "strings")
    first = crowd.where("not later")
    low = first.groupBy("string").agg(F.min("doc").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = first.groupBy("string", "row").agg(F.min("start").alias("own"))
    late = first.join(low, "string").join(own, ["string", "row"]).where("doc > low or start > own").unionByName(crowd.where("later"), allowMissingColumns=True)
    late = late.select("row", "start", (F.col("start") + length).alias("stop"))
    return found.where("kind = 1").select(*columns).unionByName(settle(few, "partial").select(*columns)).unionByName(late)


def exact_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing repeats of `length` bytes.

    A byte goes if a string of `length` bytes over it also starts earlier: in a row with a smaller doc_id, or in the same
    row at an earlier start. Null texts are empty; null doc_ids come before all others. Rows are documents each for
    themselves: of rows with one doc_id, or without one, none is earlier than another, whatever their texts, and equal
    rows get equal results. Strings are told apart by 128 bits of hash (sample and context), rows by 64.
    """
    gone = repeated_ranges(docs, length).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    return rows_of(docs).join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
