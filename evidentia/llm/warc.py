"""WARC archives: gzip member per record, written by tasks, read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, settle, settled_dir

# Fixed values of the WARC format.
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
DATE = "2020-01-01T00:00:00Z"

#: What a record's first bytes are, whatever its version.
START = b"WARC/"

BLOCK = 1 << 20
#: Bytes of records that a task holds before it hands them on.
HELD_BYTES = 4 << 20
#: Tasks over which the pages with one payload are dealt, so that an error page of a million copies isn't one task's.
SALTS = 16
#: Bits of the table of repeated digests.
BITS = 1 << 23


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, duplicate: bool) -> bytes:
    """One gzip member. A revisit keeps the HTTP header with the full payload's length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if duplicate else http + payload
    name = "null" if page_id is None else str(page_id)
    head = [f"WARC-Type: {'revisit' if duplicate else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\x00-\x20]", "", url or "about:blank")]
    if duplicate:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def first_of_equals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """pages plus refers_to (smallest page_id with the same payload) and duplicate (true for all but that page's first row).

    Copies are found on digests alone; a payload that many pages share costs one combined row a task, not a group. A bit
    table of the digests that repeat, 1 MB whatever their number, goes to all tasks: pages whose bit isn't set have no equal
    and stay where they are. Only the others are joined by digest, dealt over SALTS tasks each.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", salt).withColumn("bit", F.pmod(F.xxhash64("digest"), F.lit(BITS)) + 1)
    many = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    many = settle(many.select("digest", "first"), "repeated")
    bits = many.select((F.pmod(F.xxhash64("digest"), F.lit(BITS)) + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    seen = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = rows.withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(bits), "bucket", "left").withColumn("seen", seen)
    alone = marked.where("not seen").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("duplicate"))
    dealt = many.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    others = marked.where("seen").join(dealt, ["digest", "salt"], "left").select("page_id", "url", "payload", F.col("first").alias("refers_to"), (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("duplicate"))
    return alone.unionByName(others)


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write one archive a partition to folder (any URI that pyarrow.fs opens); (file, records) of what was written.

    A task writes to a name of its own attempt and renames it at the end, so a repeated task leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, n = f"{root}/.{name}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    for x in batch.slice(i, 64).to_pylist():
                        out.write(record(x["page_id"], x["url"], x["payload"], x["refers_to"], x["duplicate"]))
                        n += 1
        fs.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "records"])

    return first_of_equals(pages, least_bytes).mapInArrow(run, "file string, records long")


def members(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of the records whose gzip member starts in [start, end), whatever lies around them.

    The range is scanned for the gzip magic; a hit counts only if it inflates to a WARC version line. A member owned is
    read to its end, past the range too; the scan goes on behind it.
    """
    with fs.open_input_file(path) as f:
        size = f.size()
        at, window, base = start, b"", start
        while at < end:
            if not base <= at < base + max(0, len(window) - len(MAGIC)):
                base, window = at, f.read_at(min(BLOCK, size - at), at)
            hit = window.find(MAGIC, at - base)
            if hit < 0:
                at = base + max(1, len(window) - len(MAGIC) + 1)
                continue
            at = base + hit
            if at >= end:
                return
            body, stop = inflate(f, at, size, window[hit:])
            if body is None:
                at += 1
                continue
            head, _, rest = body.partition(b"\r\n\r\n")
            length = re.search(rb"\r\nContent-Length: *(\d+)", head, re.I)
            if length and len(rest) >= int(length[1]):
                yield head, rest[: int(length[1])]
                at = stop
            else:
                at += 1


def inflate(f, at: int, size: int, begun: bytes) -> tuple[bytes | None, int]:
    """Body of the member at `at` and the offset behind it; None unless it is whole and starts as a WARC record does.

    The first bytes are inflated alone, so a chance hit of the magic costs no more than them; the rest goes block by block.
    """
    inflater, place = zlib.decompressobj(31), at
    data = begun or f.read_at(min(BLOCK, size - at), at)
    try:
        place += len(data)
        out = [inflater.decompress(data, len(START))]
        data = inflater.unconsumed_tail
        while len(out[0]) < len(START) and not inflater.eof and (data or place < size):
            if not data:
                data = f.read_at(min(BLOCK, size - place), place)
                place += len(data)
            out[0] += inflater.decompress(data, len(START) - len(out[0]))
            data = inflater.unconsumed_tail
        if out[0] != START:
            return None, at
        while not inflater.eof:
            if not data:
                if place >= size:
                    return None, at
                data = f.read_at(min(BLOCK, size - place), place)
                place += len(data)
            out.append(inflater.decompress(data))
            data = b""
        return b"".join(out), place - len(inflater.unused_data)
    except zlib.error:
        return None, at


def row_of(head: bytes, block: bytes) -> dict:
    """A row of SCHEMA from any record's header and block.

    The payload of an HTTP message is what follows its header, of any other record the whole block. Where the header has no
    digest it is computed, where there is no Content-Length in the message the payload's own length counts. Ids that
    aren't those of pages, as in archives written elsewhere, are null.
    """
    field = {k.lower(): v for k, v in re.findall(r"\r\n([\w-]+):[ \t]*([^\r\n]*)", head.decode("utf-8", "replace"))}
    kind = field.get("warc-type", "")
    http, split, payload = block.partition(b"\r\n\r\n")
    if not split or not field.get("content-type", "").startswith("application/http"):
        http, payload = b"", block
    ids = [re.fullmatch(r"<?urn:page:(-?\d+)>?", field.get(name, "").strip()) for name in ("warc-record-id", "warc-refers-to")]
    length = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", http, re.I)
    digest = field.get("warc-payload-digest", "").removeprefix("sha1:") or sha1_base32(payload)
    page, refers = (int(x[1]) if x else None for x in ids)
    return {"page_id": page, "payload_bytes": int(length[1]) if length and kind == "revisit" else len(payload), "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": None if kind == "revisit" else payload}


def read(spark: SparkSession, folder: str, range_bytes: int = 4 << 20) -> DataFrame:
    """One row a record of any type: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    The driver lists the archives; tasks cut them into ranges of range_bytes and deal those out. Bytes that are no WARC
    member are skipped, whoever wrote them; records of other types and other writers come with null ids. A record is read
    whole, of any length that fits a task. An empty folder gives no rows.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    files = [(x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and x.size and os.path.basename(x.path).endswith(".warc.gz") and not os.path.basename(x.path).startswith(".")]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            held, n = [], 0
            for x in batch.to_pylist():
                for head, block in members(store, x["path"], x["start"], x["end"]):
                    held.append(row_of(head, block))
                    n += len(block)
                    if n >= HELD_BYTES:
                        yield pa.RecordBatch.from_pylist(held, SCHEMA)
                        held, n = [], 0
            yield pa.RecordBatch.from_pylist(held, SCHEMA)

    total = sum(n for _, n in files)
    listed = spark.createDataFrame(sorted(files), "path string, size long").repartition(max(1, min(len(files), parts(spark))))
    step = F.lit(range_bytes)
    ranges = listed.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step.cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + step, "size").alias("end"))
    return ranges.repartition(max(1, min(total // range_bytes + len(files), 16 * parts(spark)))).mapInArrow(run, schema)


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as archives and read them back, one row a page.

    Null html is an empty payload; a null page_id is kept and never referred to; of rows with equal page_id and payload
    each is a record of the same type. Ties go to the smallest page_id. Payloads may be as long as a task can hold; columns
    beside those three are not read; an empty table gives no rows. Without a folder the archives are in settled_dir().
    """
    spark = pages.sparkSession
    folder = folder or f"{settled_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, least_bytes).agg(F.sum("records")).collect()
    return read(spark, folder)
