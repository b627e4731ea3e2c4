"""SimHash near-duplicates: fingerprints linked within a Hamming radius through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fresh_names, linked, parts, settle
from .textbytes import LOWER, SPACE, Hasher, mixed, owner, spans

#: Children of a node of the index, and the nodes' pairs expanded at a time.
FAN, PAIRS = 8, 1 << 18


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the shingles; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)]) or digest(joined, seed)
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): one signed 64-bit fingerprint a row. Null and wordless texts have 0. A-Z is lower-cased, nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                texts = b.column(1).cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes of FAN children; a node holds the bits on which all below it agree."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        """group: the rows' bucket; a node never spans two buckets. Rows must be grouped by bucket."""
        order = np.lexsort((gray_rank(codes), group))
        self.codes, self.order, group = codes[order], order, group[order]
        full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        first = np.arange(len(codes))
        self.levels = [(self.codes, full, first, first + 1)]  # pattern, mask of shared bits, children from and to
        while True:
            pattern, mask, _, _ = self.levels[-1]
            n = len(pattern)
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
            size = np.diff(np.r_[edge, n])
            if not n or size.max() == 1:
                break
            place = np.arange(n) - np.repeat(edge, size)
            start = np.flatnonzero(place % FAN == 0)
            ones = np.bitwise_and.reduceat(pattern, start)
            some = np.bitwise_or.reduceat(pattern, start)
            shared = np.bitwise_and.reduceat(mask, start) & ~(ones ^ some)
            self.levels.append((ones & shared, shared, start, np.r_[start[1:], n]))
            group = group[start]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one bucket at most radius bits apart, as positions in Gray order, first below second.

        Pairs of nodes go down together; a pair whose shared bits already differ in more than radius places is pruned
        with all below it. The stack holds blocks of pairs, so memory doesn't grow with the number of links.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots[i : i + PAIRS // FAN], roots[i : i + PAIRS // FAN]) for i in range(0, len(roots), PAIRS // FAN)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                keep = a < b
                yield a[keep], b[keep]
                continue
            _, _, lo, hi = self.levels[level]
            na, nb = hi[a] - lo[a], hi[b] - lo[b]
            n = na * nb
            pair = np.repeat(np.arange(len(a)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x, y = lo[a][pair] + k // nb[pair], lo[b][pair] + k % nb[pair]
            pattern, mask, _, _ = self.levels[level - 1]
            keep = (x <= y) & (np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= radius)
            x, y = x[keep], y[keep]
            step = PAIRS // (FAN * FAN)
            stack += [(level - 1, x[i : i + step], y[i : i + step]) for i in range(0, len(x), step)]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position reachable from each of n positions."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            odd = ra != rb
            if not odd.any():
                break
            a, b, ra, rb = a[odd], b[odd], ra[odd], rb[odd]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def link_buckets(batches: Iterator[pa.RecordBatch], radius: int, at_once: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp) sorted by bucket -> a spanning star (a, b) of each bucket's components; whole buckets at a time."""

    def emit(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        index = GrayIndex(fp.view(np.uint64), bucket)
        root = forest(len(fp), index.links(radius))
        own = fp[index.order]
        far = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(own[root[far]])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= at_once:
            bucket, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield emit(bucket[:cut], fp[:cut])
            held, n = [(bucket[cut:], fp[cut:])], len(bucket) - cut
    if n:
        yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_links(codes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that span the components of distinct codes (column fp) at most radius bits apart.

    radius + 1 blocks of bits: two codes so near agree on one block whole, so each block's value is a bucket.
    """
    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keyed = codes.select("fp", F.posexplode(F.array(*[F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)])).alias("block", "value"))
    keyed = keyed.select((F.col("value") * blocks + F.col("block")).alias("bucket"), "fp")
    n = parts(codes.sparkSession)
    return keyed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: link_buckets(it, radius), "a long, b long")


def near_components(docs: DataFrame, width: int, radius: int = 3) -> DataFrame:
    """One row a document: doc_id, fp, component_id (smallest doc_id reachable over links of radius bits or fewer).

    Equal fingerprints are one node, however many documents share them. Null doc_ids take part; a component of null
    ids only has a null component_id. Repeated rows stay repeated. An empty table gives no rows.
    """
    rows = settle(fingerprints(docs, width), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    of = linked(near_links(nodes.select("fp"), radius))
    nodes = nodes.join(of.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(nodes.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---- near copies: bands of min-hashes deal the texts, the Gray-order index compares them, whole shingle sets decide ----

#: Bands of min-hashes and min-hashes of a band: at similarity 0.8 all but 2 pairs in 10,000 agree on a band.
BANDS, ROWS = 16, 4
#: Bits that the fingerprints of two shingle sets of similarity 0.8 differ in: 9.7 on average, more in 2 pairs of 10,000.
NEAR_BITS = 20
#: Rows of a crowded bucket, and shingles of those rows, that are compared with each other or with as many others at a time.
TILE, TILE_SHINGLES = 1024, 1 << 18
#: A shingle in more rows of two tiles is common: a pair is taken to share as many of these as the poorer row has.
COMMON = 16


def set_fingerprints(text: np.ndarray, token: np.ndarray, texts: int) -> np.ndarray:
    """SimHash of each text's set of tokens (sorted by text, then token; repeats don't count), 1 << 18 tokens at a time."""
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    text, token = text[fresh], token[fresh]
    ones = np.zeros((texts, 64), np.int64)
    for a in range(0, len(token), 1 << 18):
        own = text[a : a + (1 << 18)]
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits = np.unpackbits(token[a : a + (1 << 18)].view(np.uint8)).reshape(-1, 64)
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.bincount(text, minlength=texts)[:, None], axis=1).view(np.uint64)[:, 0]


def signatures(data: np.ndarray, ends: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have a word, [those, size] min-hashes of their shingles (A-Z lower-cased; fewer words than width are one), their fingerprints."""
    start, stop = spans(~SPACE[data], ends)
    text, words = owner(ends, start), Hasher(LOWER[data])(start, stop)
    token, n = words.copy(), len(words)
    for i in range(1, min(width, n)):
        token[: n - i] = np.where(text[i:] == text[: n - i], token[: n - i] * np.uint64(0x9E3779B97F4A7C15) + words[i:], token[: n - i])
    token = mixed(token)
    first = np.searchsorted(text, np.arange(len(ends)))
    whole = np.arange(n) - first[text] < np.maximum(1, np.diff(first)[text] - width + 1)
    token, text = token[whole], text[whole]
    some, first = np.unique(text, return_index=True)
    out = np.zeros((len(some), size), np.uint64)
    for k in range(size if len(some) else 0):
        out[:, k] = np.minimum.reduceat(mixed(token ^ np.uint64(0xA24BAED4963EE407 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)), first)
    order = np.lexsort((token, text))
    return some, out, set_fingerprints(np.searchsorted(some, text[order]), token[order], len(some))


def band_buckets(mins: np.ndarray) -> np.ndarray:
    """[texts, BANDS] keys, equal where all min-hashes of a band are; a key modulo BANDS is its band."""
    out = np.zeros((len(mins), BANDS), np.uint64)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + mins[:, k::ROWS])
    return out // np.uint64(BANDS) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)


def shingle_set(text: bytes, width: int) -> bytes:
    """Sorted 32-bit hashes of the distinct shingles (A-Z lower-cased); fewer words than width are one shingle."""
    words = text.lower().split()
    h = [xxhash.xxh32_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))] if words else []
    return np.unique(np.array(h, np.uint32)).tobytes()


def band_links(batches: Iterator[pa.RecordBatch], at_once: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, row, fp) sorted by bucket -> candidate links (a, b) of each row to its bucket's middle, first and next in Gray order.

    The middle is the row nearest to the bits that most of the bucket have: what variants are variants of, where it is there.
    """

    def emit(bucket: np.ndarray, rows: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        code = fp.view(np.uint64)
        order = np.lexsort((rows, gray_rank(code), bucket))
        bucket, rows, code = bucket[order], rows[order], code[order]
        new = np.ones(len(rows), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        x = np.flatnonzero(~new)
        edge = np.flatnonzero(new)
        size = np.diff(np.r_[edge, len(rows)])
        bits = np.unpackbits(code.view(np.uint8)).reshape(-1, 64)
        most = np.packbits(2 * np.add.reduceat(bits, edge, axis=0, dtype=np.int64) > size[:, None], axis=1).view(np.uint64)[:, 0]
        far = np.bitwise_count(code ^ np.repeat(most, size)).astype(np.int64)
        middle = np.repeat(np.minimum.reduceat(far << 32 | np.arange(len(rows)), edge) & 0xFFFFFFFF, size)
        first = np.repeat(edge, size)
        every = np.arange(len(rows))
        x, y = np.r_[x, x, every], np.r_[first[x], x - 1, middle]
        near = (x != y) & (np.bitwise_count(code[x] ^ code[y]) <= NEAR_BITS)
        return pa.RecordBatch.from_arrays([pa.array(rows[x[near]]), pa.array(rows[y[near]])], ["a", "b"])

    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(3)])
        n += batch.num_rows
        if n >= at_once:
            bucket, rows, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield emit(bucket[:cut], rows[:cut], fp[:cut])
            held, n = [[bucket[cut:], rows[cut:], fp[cut:]]], len(bucket) - cut
    if n:
        yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


class Overlaps:
    """Upper bounds of the shingles that two rows share: rare shingles counted pair by pair, common ones as in the poorer row."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        owner_of = np.repeat(np.arange(len(sets)), self.size)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        count = count[token]
        self.common = np.bincount(owner_of[count > COMMON], minlength=len(sets))
        rare = np.flatnonzero((count > 1) & (count <= COMMON))
        #: shingles of each row that another row has
        self.shared = self.common + np.bincount(owner_of[rare], minlength=len(sets))
        rare = rare[np.argsort(token[rare], kind="stable")]
        token, holder = token[rare], owner_of[rare]
        pairs = [np.zeros(0, np.int64)]
        for step in range(1, min(COMMON, len(token))):
            same = token[step:] == token[: len(token) - step]
            pairs.append(holder[: len(token) - step][same] * len(sets) + holder[step:][same])
        self.pair, self.both = np.unique(np.concatenate(pairs), return_counts=True)

    def most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.minimum(self.common[x], self.common[y])
        if len(self.pair):
            key = np.minimum(x, y) * len(self.size) + np.maximum(x, y)
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            out = out + np.where(self.pair[at] == key, self.both[at], 0)
        return out


def crowd_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, p, q, tile, row, root, fp, shingles) sorted by bucket, p, q -> links (a, b) that connect all roots that can be.

    A link joins a row of tile p to one of tile q that are within NEAR_BITS and, by their whole shingle sets, similar.
    Rows and pairs that cannot share enough shingles are left out by a bound, and so are pairs that earlier links connect.
    """

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both)

    def emit(p: int, q: int, tile: np.ndarray, rows: np.ndarray, root: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        bound = Overlaps(sets)
        able = np.flatnonzero((bound.shared >= similarity * bound.size - 1e-9) & (bound.size > 0))
        index = GrayIndex(fp[able].view(np.uint64), np.zeros(len(able), np.int64))
        at = able[index.order]
        _, root = np.unique(root, return_inverse=True)
        of, out = np.arange(len(root)), []
        for x, y in index.links(NEAR_BITS):
            x, y = at[x], at[y]
            fair = (of[root[x]] != of[root[y]]) & ((tile[x] != tile[y]) | (p == q))
            x, y = x[fair], y[fair]
            fair = bound.most(x, y) * (1 + similarity) >= similarity * (bound.size[x] + bound.size[y]) - 1e-6
            for i, j in zip(x[fair].tolist(), y[fair].tolist(), strict=True):
                a, b = of[root[i]], of[root[j]]
                if a != b and alike(sets[i], sets[j]):
                    of[of == b] = a
                    out.append((rows[i], rows[j]))
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    def whole(held: list) -> tuple:
        return (*(np.concatenate([h[i] for h in held]) for i in range(4)), [s for h in held for s in h[4]])

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        columns = [batch.column(i).to_numpy() for i in range(3, 7)]
        edge = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            now = tuple(key[a].tolist())
            if now != last and held:
                yield emit(last[1], last[2], *whole(held))
                held = []
            last = now
            held.append([*(x[a:b] for x in columns), [np.frombuffer(s, np.uint32) for s in batch.column(7).slice(a, b - a).to_pylist()]])
    if held:
        yield emit(last[1], last[2], *whole(held))


#: What tells rows apart: doc_id and 96 bits of hash of the text.
IDENTITY = ["doc_id", "h", "g"]


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h, g) of the rows that have an id and a text."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("g", F.hash("text"))


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, g, keeper) of every document that isn't its group's keeper: the smallest doc_id, then the smallest hash.

    Documents are linked if their texts are equal or their sets of `width`-word shingles have a Jaccard similarity of
    `similarity` or more. Candidates agree on all min-hashes of one of BANDS and within NEAR_BITS of their fingerprints,
    wherever the texts differ: a bucket's rows lie under a Gray-order index, whose groups are pruned whole. Every
    candidate is verified on whole shingle sets, or connected by others that are. Rows that share a doc_id but not the
    text are documents of their own. Null doc_ids and null texts take no part.
    """
    n = parts(docs.sparkSession)
    keyed = identified(docs).withColumn("row", F.xxhash64(*IDENTITY))
    firsts = settle(keyed.groupBy("h", "g").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("h", "g", "first.doc_id", "first.row"), "firsts")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in chunks(batches, "text"):
            some, mins, fp = signatures(data, ends, width, BANDS * ROWS)
            buckets = pa.FixedSizeListArray.from_arrays(pa.array(band_buckets(mins).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), buckets, pa.array(fp.view(np.int64))], ["row", "buckets", "fp"])

    coded = keyed.select("row", "text").mapInArrow(code, "row long, buckets array<long>, fp long")
    coded = settle(coded.join(firsts.select("row"), "row", "left_semi").dropDuplicates(["row"]), "codes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["row", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                good = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both >= similarity * (len(x) + len(y) - both) and len(x) + len(y) > 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def shingled(ends: DataFrame, name: str) -> DataFrame:
        return settle(keyed.select("row", "text").join(ends.hint("merge"), "row", "left_semi").mapInArrow(sets, "row long, shingles binary").dropDuplicates(["row"]), name)

    dealt = coded.select(F.explode("buckets").alias("bucket"), "row", "fp")
    links = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(band_links, "a long, b long")
    candidates = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "candidates")
    own = shingled(candidates.select(F.col("a").alias("row")).union(candidates.select("b")).distinct(), "shingles")
    pairs = candidates.join(own.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    good = settle(pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "verified")
    of = linked(good)
    # buckets of up to three rows are compared whole; in larger ones every pair that is not yet connected is compared now
    placed = settle(coded.join(of.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row")), "placed").select(F.explode("buckets").alias("bucket"), "row", "root", "fp")
    crowds = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("size > 3 and lo < hi").select("bucket")
    inside = settle(placed.join(crowds, "bucket"), "crowds")
    own = shingled(inside.select("row").distinct(), "crowded")
    weight = inside.join(own.select("row", (F.octet_length("shingles") / 4).alias("n")), "row").groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    weight = weight.select("bucket", F.ceil(F.greatest(F.col("size") / TILE, F.col("n") / TILE_SHINGLES)).alias("tiles"))
    tiles = inside.join(weight, "bucket").withColumn("tile", F.pmod(F.xxhash64("row"), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiles = tiles.join(own, "row").select("bucket", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "row", "root", "fp", "shingles")
    more = settle(tiles.repartition(n, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(lambda it: crowd_links(it, similarity), "a long, b long"), "more")
    if not more.isEmpty():
        of = linked(good.union(more))
    grouped = firsts.join(of.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    keepers = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "h", "g")).alias("keeper"))
    grouped = grouped.join(keepers, "root").select("h", "g", "keeper")
    rest = keyed.select(*IDENTITY).distinct().join(grouped, ["h", "g"])
    return rest.where(F.struct("doc_id", "h", "g") != F.col("keeper")).select(*IDENTITY, F.col("keeper.doc_id").alias("keeper"))


def without_copies(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, all columns, without the rows of gone (doc_id, h, g).

    Of rows that repeat a doc_id and a text one stays, the first by the hash of all its columns; rows that share a doc_id
    only are separate documents, and rows without one or without a text all stay.
    """
    fresh = fresh_names(docs, "h", "g", "row", "rank")
    h, g, row, rank = fresh
    own = docs.withColumns({h: F.xxhash64(F.col("text").cast("string")), g: F.hash(F.col("text").cast("string")), row: F.when(F.col("doc_id").isNull() | F.col("text").isNull(), F.monotonically_increasing_id())})
    left = own.join(gone.select(F.col("doc_id").alias("doc_id"), F.col("h").alias(h), F.col("g").alias(g)).distinct().hint("merge"), ["doc_id", h, g], "left_anti")
    by = Window.partitionBy("doc_id", h, g, row).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return left.withColumn(rank, F.row_number().over(by)).where(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
