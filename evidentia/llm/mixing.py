"""Mixing sources to target weights: whole copies first, then Pareto order sampling of the rest. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh_names, settle

#: Bins of the Pareto rank in which the cut of a source is found before the one bin it falls into is sorted.
BINS = 1024


def targets(sizes: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    Weights 1, 2, 3, repeating, go by the order of source (code points, null last) and share the sum of all sizes; a
    target stops at cap times the source's size and the excess is reshared by weight. Filling up by rising size per
    weight meets every cap in one pass: the k-th source is capped while the share left exceeds cap times its size.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sizes.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), "w", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = (
        rows.withColumn("capped", cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("open", F.min(F.when(F.col("level") * F.col("w") <= cap * F.col("source_size"), F.struct("place", "level"))).over(whole))
    )
    full = F.col("place") < F.col("open.place")
    return rows.select("source", "source_size", F.when(full, cap * F.col("source_size")).otherwise(F.col("open.level") * F.col("w")).cast("double").alias("target"))


MADE = ("size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, cap: int = 3, seed: int = 42, carry: bool = False) -> DataFrame:
    """One row a row of docs: doc_id, size, source_size, target, copies, taken (copies * size).

    With carry the columns of docs come first, unchanged (a corpus to write, each row `copies` times); where one is named
    like a column made here, in any case, that one is named by MADE under fresh_names(docs, *MADE).

    A document's expected copies rise with its length class (1 + floor(log2(1 + size))), are at most cap, and sum to the
    source's target in words. The whole part is allocated outright. The fraction p is the inclusion probability of one more
    copy: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of doc_id and size, and taken in that order until
    the next one would exceed the words that the source still lacks; the one document nearest in size to what is left is
    added. Passes go over narrow rows; the cut is found in a histogram of BINS per source, so a source that holds most
    rows is never sorted by one task.
    Null texts have size 0 and no copy; a null source is a source; rows repeated in the input are separate rows.
    """
    word_count = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    base = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count.cast("long").alias("size"), *whole).withColumn("row", F.monotonically_increasing_id()), "sizes")
    base = base.withColumn("weight", F.length(F.bin("size")).cast("double"))
    # one row for each source and length class: the copies of a class are min(cap, level * weight)
    classes = base.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    goal = settle(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), cap), "targets")
    same = F.col("c.source").eqNullSafe(F.col("g.source"))
    heavy = Window.partitionBy("source").orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    light = Window.partitionBy("source").orderBy(F.col("weight").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = Window.partitionBy("source")
    plan = (
        classes.alias("c")
        .join(goal.alias("g"), same)
        .select("c.*", "g.source_size", "g.target")
        .withColumn("level", (F.col("target") - cap * F.coalesce(F.sum("words").over(heavy), F.lit(0))) / F.nullif(F.sum(F.col("words") * F.col("weight")).over(light), F.lit(0.0)))
        .withColumn("open", F.max(F.when(F.coalesce(F.col("level") * F.col("weight") < cap, F.lit(True)), F.struct("weight", "level"))).over(own))
        .withColumn("full", F.coalesce(F.col("weight") > F.col("open.weight"), F.lit(True)))
        .withColumn("expected", F.when(F.col("full"), F.lit(float(cap))).otherwise(F.coalesce(F.col("open.level") * F.col("weight"), F.lit(0.0))))
        .withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("long"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    )
    plan = settle(plan.withColumn("lack", F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own))).select("source", "weight", "source_size", "target", "whole", "p", "lack"), "plan")
    u = (F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = (
        base.alias("b")
        .join(plan.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.weight") == F.col("c.weight")), "left")
        .select("b.row", "b.doc_id", "b.source", "b.size", *["b.doc"] * carry, "source_size", "target", "whole", "lack", F.when((F.col("p") > 0) & (F.col("b.size") > 0), odds).alias("odds"))
        .withColumn("bin", F.floor(F.col("odds") / (1 + F.col("odds")) * BINS).cast("int"))
    )
    bins = ranked.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("lack").alias("lack"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut = settle(bins.where("before <= lack and before + words > lack").select("source", F.col("bin").alias("cut_bin"), "before", "lack"), "cut")
    by_source = F.col("r.source").eqNullSafe(F.col("k.source"))
    run = Window.partitionBy("source").orderBy("odds", "doc_id", "size", "row")
    edge = ranked.alias("r").join(cut.alias("k"), by_source & (F.col("r.bin") == F.col("cut_bin"))).select("r.*", "before")
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(run)).select("row", "source", "odds", "doc_id", "size", F.col("upto"), (F.col("upto") <= F.col("lack")).alias("fits"))
    edge = settle(edge, "edge")
    # where the order stops short of the target, the document nearest in size to what is left is added
    last = edge.where("fits").groupBy("source").agg(F.max(F.struct("odds", "doc_id", "size", "row")).alias("last"), F.max("upto").alias("upto"))
    cut = cut.alias("c").join(last.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left").select("c.*", "last", (F.col("lack") - F.coalesce("upto", "before")).alias("short"))
    cut = settle(cut, "cut")
    in_order = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.struct("odds", "doc_id", "size", "row") <= F.col("last")))
    placed = ranked.alias("r").join(cut.alias("k"), by_source, "left").select("r.*", "cut_bin", "short", F.when(F.col("cut_bin").isNull(), F.col("bin").isNotNull() & (F.col("r.lack") > 0)).otherwise(F.coalesce(in_order, F.lit(False))).alias("chosen"))
    gap = F.abs(F.col("size") - F.col("short"))
    more = placed.where(~F.col("chosen") & F.col("bin").isNotNull() & (gap < F.col("short"))).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "odds", "doc_id", "row")).alias("best"))
    more = settle(more.select("source", "best.row"), "more")
    out = placed.alias("r").join(more.alias("k"), by_source, "left")
    own = [F.col(f"doc.`{c}`") for c in docs.columns] if carry else [F.col("doc_id")]
    copies = F.coalesce("whole", F.lit(0)) + F.coalesce(F.col("chosen") | (F.col("k.row") == F.col("r.row")), F.lit(False)).cast("long")
    made = F.col("r.size"), F.col("source_size"), F.col("target"), copies, copies * F.col("r.size")
    names = fresh_names(docs, *MADE) if carry else MADE
    return out.select(*own, *[x.alias(n) for x, n in zip(made, names, strict=True)])
