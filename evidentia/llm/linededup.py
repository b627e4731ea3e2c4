"""Line deduplication: line hashes in range partitions, sorted by document, streamed; the result are bitmaps of lines to keep."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, chunks, parts, settle

#: Code points of the shortest line that can go, and documents that must hold it.
LEAST_POINTS, LEAST_DOCS = 20, 3
BLANK = b" \t\n\x0b\x0c\r"
#: Place in the order of documents of those without an id: before all others.
NO_ID = -(1 << 63)
#: Rows that a task streams at once. A run of equal lines that is longer is settled like one that crosses partitions.
AT_ONCE = 500_000
#: So many keys of such runs (32 bytes each) are sent to all tasks; more are joined.
BROADCAST_KEYS = 1 << 20

#: What a row of the stream means: its lines go; it stands for a document of an open run; it waits for that run's verdict.
GONE, SEEN, OPEN = 0, 1, 2
LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("at", pa.binary())])
STATES = LINES.append(pa.field("state", pa.int8()))
STATES_DDL = "h1 long, h2 long, doc long, row long, at binary, state byte"


def keys(text: bytes) -> dict[bytes, list[int]]:
    """128-bit hash of each line that is long enough, stripped and lower-cased (A-Z), with the places of its lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.translate(LOWER_ASCII).split(b"\n")):
        key = line.strip(BLANK)
        if len(key) >= LEAST_POINTS and (key.isascii() or len(key.decode()) >= LEAST_POINTS):
            found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
    return found


def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, text) -> a row for each document and key."""
    for batch, data, ends in chunks(batches, "text"):
        doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        body, hashes, own, at = data.tobytes(), [], [], []
        for i in range(batch.num_rows):
            found = keys(body[ends[i] : ends[i + 1]])
            hashes += found
            own += [i] * len(found)
            at += [np.array(x, np.uint32).tobytes() for x in found.values()]
        h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((h[:, 0], h[:, 1], doc[own], row[own], at), LINES.types, strict=True)], schema=LINES)


def stream(batches: Iterator[pa.RecordBatch], at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, doc descending) -> those whose lines go, and the rows of open runs.

    The first document of a run keeps its lines, if the run has enough documents the others lose theirs. A partition's
    first and last run may go on next door: such a run is open. Of it the first LEAST_DOCS documents are told, and all rows
    are handed on.
    """

    def judge(t: pa.Table, first_open: bool, last_open: bool) -> pa.RecordBatch:
        h1, h2, doc = (t[c].to_numpy() for c in ("h1", "h2", "doc"))
        new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_run | np.r_[True, doc[1:] != doc[:-1]]
        run, count = np.cumsum(new_run) - 1, np.cumsum(new_doc)
        place = count - count[np.flatnonzero(new_run)][run]
        docs = np.bincount(run, new_doc).astype(np.int64)[run]
        open_ = (run == 0) & first_open | (run == run[-1]) & last_open
        state = np.where(open_, np.where(new_doc & (place < LEAST_DOCS), SEEN, OPEN), GONE).astype(np.int8)
        wanted = pa.array(open_ | (place > 0) & (docs >= LEAST_DOCS))
        return t.append_column(STATES.field("state"), pa.array(state)).filter(wanted).combine_chunks()

    def send(t: pa.Table, first_open: bool, last_open: bool) -> Iterator[pa.RecordBatch]:
        if len(t):
            yield from judge(t, first_open, last_open).to_batches()

    held, n, since = [], 0, None  # since: whether the first run held is open
    for batch in batches:
        if not batch.num_rows:
            continue
        since = True if since is None else since
        held.append(batch)
        n += batch.num_rows
        if n < at_once:
            continue
        t = pa.Table.from_batches(held)
        last = (t["h1"].to_numpy() == t["h1"][-1].as_py()) & (t["h2"].to_numpy() == t["h2"][-1].as_py())
        start = int(last.argmax())
        if start:
            yield from send(t.slice(0, start), since, False)
            held, n, since = t.slice(start).combine_chunks().to_batches(), len(t) - start, False
        else:
            yield from send(t, True, True)
            # one row stays, so that the run is known again
            held, n, since = t.slice(len(t) - 1).combine_chunks().to_batches(), 1, True
    if held:
        yield from send(pa.Table.from_batches(held), since, True)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, row, text): doc is the place in the order of documents, row tells texts under one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text")


def dropped(docs: DataFrame) -> DataFrame:
    """(doc, row, at): places of lines that go, of rows of identified(docs); a place may come more than once."""
    n = parts(docs.sparkSession)
    lines = settle(docs.select("doc", "row", "text").mapInArrow(hash_lines, "h1 long, h2 long, doc long, row long, at binary"), "lines")
    order: list[Column] = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    # a key of very many documents is cut between documents, too
    ranged = lines.repartitionByRange(n, *order, F.col("row")).sortWithinPartitions(*order, "row")
    states = settle(ranged.mapInArrow(stream, STATES_DDL), "states")
    verdict = states.where(F.col("state") == SEEN).groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count_distinct("doc").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    verdict = settle(verdict.drop("docs"), "verdict")
    small = verdict.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    late = states.where(F.col("state") != GONE).join(F.broadcast(verdict) if small else verdict, ["h1", "h2"]).where("doc < keeper")
    return states.where(F.col("state") == GONE).select("doc", "row", "at").unionByName(late.select("doc", "row", "at"))


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, doc, row, n_lines, n_dropped, keep.

    keep is a zlib-compressed bitmap, a bit a line of the text (the first is the highest bit of the first byte), null where
    every line stays. A line goes if its key, the line without blanks at its ends and with A-Z lower-cased, has LEAST_POINTS
    code points or more and stands in LEAST_DOCS documents or more, of which this isn't the one of largest doc_id.
    Documents are told apart by doc_id: texts under one doc_id are one document, as are all without an id, which come
    before the others. Null and empty texts are one empty line; equal rows fare alike; other columns are not read.
    """
    rows = identified(docs)
    gone = settle(dropped(rows), "gone").groupBy("doc", "row").agg(F.collect_set("at").alias("gone"))
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    joined = rows.select("doc_id", "doc", "row", lines.alias("n_lines")).join(gone, ["doc", "row"], "left").select("doc_id", "doc", "row", "n_lines", "gone")
    return joined.mapInArrow(bitmaps, "doc_id long, doc long, row long, n_lines long, n_dropped long, keep binary")


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_dropped, keep = [], []
        for n, gone in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            bits = np.ones(n if gone else 0, bool)
            for at in gone or ():
                bits[np.frombuffer(at, np.uint32)] = False
            n_dropped.append(int((~bits).sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes()) if gone else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "doc", "row", "n_lines", "n_dropped", "keep"])


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    """The lines of text that the bitmap keeps, joined."""
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    return b"\n".join([lines[i] for i in np.flatnonzero(bits)])


def kept_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text as bytes), a row a row of docs, under the bitmaps of line_bitmaps(docs)."""
    once = found.dropDuplicates(["doc", "row"]).select("doc", "row", "n_lines", "n_dropped", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                text = [kept_text(t.as_py(), k.as_py()) for t, k in zip(b.column(3), b.column(4), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text, pa.binary())], ["doc_id", "n_lines", "n_dropped", "text"])

    joined = identified(docs).join(once, ["doc", "row"]).select("doc_id", "n_lines", "n_dropped", F.col("text").cast("binary").alias("text"), "keep")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text binary")


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of docs after its dropped lines."""
    found = settle(line_bitmaps(docs), "bitmaps")
    return kept_texts(docs, found).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
