"""Source divergence audit: every two sources of a language compared over all its terms, without visiting the absent ones.

Sums over a whole vocabulary are taken by inclusion and exclusion over the sources' supports: what all terms would add if
neither source had them, what each source's own terms add to that if the other lacks them (priced on a histogram of its
counts), and a correction for the terms that both have (a join of the posting lists).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, chunks, parts, settle

#: A term is a run of these bytes: letters A-Z of either case and all code points above 127.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of a language that must hold a term, parts of a probability, terms told of a source.
LEAST_DOCS, PARTS, TOP = 3, 1_000_000_000, 200
#: Distinct (language, source, term) that a task holds before it hands their counts on.
HELD = 600_000
#: Sources of a language that meet in one tile of a term's posting list.
TILE = 256


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed over a task's documents as far as memory goes."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            if n:
                columns = [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch, data, ends in chunks(batches, "text"):
        low = data.tobytes().translate(LOWER_ASCII)
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            n, docs = groups.setdefault(key, (Counter(), Counter()))
            held -= len(n)
            terms = TERM.findall(low[ends[i] : ends[i + 1]])
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def exact_sum(x: Column) -> Column:
    """Sum of a long column as decimal(38, 0): the halves of the numbers are summed as longs, which don't overflow."""
    low = F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(38,0)")
    return (F.sum(F.shiftright(x, 32)).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(17,0)") + low).cast("decimal(38,0)")


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / (total + kept)) as a long; null without terms."""
    whole = (count + 1).cast("decimal(25,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return (F.call_function("div", whole, F.nullif(total + kept, F.lit(0)).cast("decimal(25,0)")) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q). Probabilities are at most PARTS + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def price_postings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (gid, lang, source, kept, p0) and postings (gid, lang, term, p, p0, q) of the terms kept.

    kept is the number of terms that the language keeps, p0 the price of an absent term, q a term's price in the language.
    All that concerns a term of a language meets in one shuffle: its counts by source, its documents, its total.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    named = settle(rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).select("lang", "source", F.monotonically_increasing_id().alias("gid")), "groups")
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long").repartition(parts(docs.sparkSession), "lang", "term")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"held": F.sum("docs").over(of), "lang_n": F.sum("n").over(of), "first": F.row_number().over(of.orderBy("source")) == 1})
    own = settle(counted.where(F.col("held") >= LEAST_DOCS).join(named, ["lang", "source"]).select("gid", "lang", "term", "n", "lang_n", "first"), "postings")
    langs = own.where("first").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = named.join(langs, "lang", "left").join(own.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").na.fill(0, ["kept", "lang_total", "total"])
    groups = settle(groups.withColumn("p0", price(F.lit(0), F.col("total"), F.col("kept"))), "priced")
    priced = own.join(groups.drop("lang", "source"), "gid").withColumns({"p": price(F.col("n"), F.col("total"), F.col("kept")), "q": price(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
    return groups, settle(priced.select("gid", "lang", "term", "p", "p0", "q"), "prices")


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(gid, lang, source, item, value) for every two sources of a language, both ways."""
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.gid") != F.col("b.gid")))
    pairs = settle(pairs.select("a.gid", F.col("b.gid").alias("other"), "a.lang", "a.source", F.col("b.source").alias("item"), F.col("a.kept").alias("kept"), "a.p0", F.col("b.p0").alias("q0")), "pairs")
    absent = gap(F.col("p0"), F.col("q0"))
    # a source's terms cost by their price alone where the other source lacks them
    histogram = settle(postings.groupBy("gid", "p").agg(F.count("*").alias("terms")), "histogram")
    mine = pairs.join(histogram, "gid").select("gid", "other", (gap(F.col("p"), F.col("q0")) - absent).alias("x"), "terms")
    theirs = pairs.join(histogram.withColumnRenamed("gid", "other"), "other").select("gid", "other", (gap(F.col("p0"), F.col("p")) - absent).alias("x"), "terms")
    product = F.col("x").cast("decimal(20,0)") * F.col("terms").cast("decimal(15,0)")
    alone = mine.unionByName(theirs).groupBy("gid", "other").agg(F.sum(product).cast("decimal(38,0)").alias("alone"))
    # what both have was priced twice as one-sided: the posting lists meet, tile by tile of a language's sources
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = postings.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("gid"), F.col("tiles")).cast("int")).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = dealt.select("lang", "term", F.col("tile").alias("x"), F.col("meets").alias("y"), "gid", "p", "p0")
    right = dealt.select("lang", "term", F.col("meets").alias("x"), F.col("tile").alias("y"), F.col("gid").alias("other"), F.col("p").alias("r"), F.col("p0").alias("r0"))
    met = left.join(right, ["lang", "term", "x", "y"]).where("gid < other")
    turn = lambda p, p0, r, r0: gap(p, r) - gap(p, r0) - gap(p0, r) + gap(p0, r0)
    c = {k: F.col(k) for k in ("p", "p0", "r", "r0")}
    both = met.groupBy("gid", "other").agg(exact_sum(turn(c["p"], c["p0"], c["r"], c["r0"])).alias("there"), exact_sum(turn(c["r"], c["r0"], c["p"], c["p0"])).alias("back"))
    both = settle(both, "overlaps")
    both = both.select("gid", "other", F.col("there").alias("both")).unionByName(both.select(F.col("other").alias("gid"), F.col("gid").alias("other"), F.col("back").alias("both")))
    nothing = F.lit(0).cast("decimal(38,0)")
    value = F.coalesce(F.col("kept").cast("decimal(18,0)") * absent.cast("decimal(19,0)"), nothing) + F.coalesce("alone", nothing) + F.coalesce("both", nothing)
    return pairs.join(alone, ["gid", "other"], "left").join(both, ["gid", "other"], "left").select("gid", "lang", "source", "item", value.cast("long").alias("value"))


def term_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(gid, lang, source, item, value) for the terms that a source has more often than its language."""
    more = postings.where("p > q").select("gid", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return more.join(groups.select("gid", "lang", "source"), "gid").select("gid", "lang", "source", "item", "value")


def source_divergence(docs: DataFrame) -> DataFrame:
    """One row a finding: lang, source, part, item, value, rank.

    Terms are runs of letters A-Z (lower-cased) and code points above 127; a language keeps those in LEAST_DOCS or more of
    its rows of docs (lang, source, text). Prices are 1 + floor(PARTS * (count + 1) / (total + terms kept)). Part `pair`
    has every other source of the language with the sum of (p - q)**2 // q over all its terms, all ranks; part `term` the
    TOP terms by (p - q)**2 // q against the language's price q, among those the source has with p > q. Ranks go by value,
    then item. Null text, lang and source are empty ones; sources without terms are compared, too, by 0 where the language
    keeps no term; repeated rows count each; other columns are not read.
    """
    groups, postings = price_postings(docs)
    order = Window.partitionBy("gid").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order)
    pairs = pair_values(groups, postings).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    words = term_values(groups, postings).withColumn("rank", rank).where(F.col("rank") <= TOP).withColumn("part", F.lit("term"))
    return pairs.unionByName(words).select("lang", "source", "part", "item", "value", "rank")
