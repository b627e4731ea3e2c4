"""Quality rules: base limits and a learned decision list of threshold conjunctions. DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh_names, let, settle

WINDOW = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"

#: Labelled rows that a list is fitted on at most: those of smallest hash.
FIT_ROWS = 20_000
#: Thresholds tried for each measure, conditions in a rule, and rules in a list.
CUTS, CONDITIONS, RULES = 24, 3, 12
#: A rule must reach this precision on rows kept from its growing, and cover so many of them.
PRECISION, COVER = 0.9, 5
#: Of the cuts with so much of the best gain the one that meets fewest rows is taken, away from the good rows.
NEAR = 0.97


def repeat_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more in words (the first one included)."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        step = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        total = lambda p: F.aggregate(p, step, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")))["n"]
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, lambda s: let(places(s), total)))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """Struct of the counts of a whole text; a null text has none of anything."""

    def of(t: Column) -> Column:
        words = F.array_remove(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
        bare = F.length(F.translate(t, SPACES, ""))
        less = lambda marks: F.length(t) - F.length(F.translate(t, marks, ""))

        def counts(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                bare.cast("long").alias("word_chars"),
                less(SYMBOLS).cast("long").alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                less(UPPER).cast("long").alias("n_upper"),
                less("!").cast("long").alias("n_shouts"),
                (less("\n") + 1).cast("long").alias("n_lines"),
            )

        return let(words, counts)

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_shouts", "n_lines")
MEASURES = ("symbols_per_char", "upper_per_char", "shouts_per_word", "chars_per_word", "repeated_share", "distinct_share", "same_lines_share", "words")


def ratios(m: Column) -> list[Column]:
    """MEASURES, what the conditions are on, from the struct of counts."""
    words, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1))
    shares = (m["n_symbols"] / chars, m["n_upper"] / chars, m["n_shouts"] / words, m["word_chars"] / words, m["n_repeat_words"] / words, m["n_distinct"] / words, m["n_dup_lines"] / m["n_lines"])
    return [x.alias(n) for n, x in zip(MEASURES, (*shares, m["n_words"].cast("double")), strict=True)]


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def column(self, r: Column) -> Column:
        return r[self.measure] > self.cut if self.above else r[self.measure] <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


def both(conditions: list[Condition], r: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column(r)
    return out


def fit(rows: DataFrame) -> list[list[Condition]]:
    """Sequential covering over rows (bad boolean, growing boolean, measures): rules for bad, in order.

    The rows, at most FIT_ROWS, are binned at the quantiles of each measure and counted by bins and label in one job; the
    counts come to the driver, and the covering goes over them. A rule grows by the condition of highest information
    gain on growing rows, loses its last conditions while that doesn't lower its precision on the others, and is kept if
    it meets PRECISION and COVER there.
    """
    names = MEASURES
    at = [(i + 0.5) / CUTS for i in range(CUTS)]
    found = rows.agg(*[F.percentile_approx(n, at, 2000).alias(n) for n in names], *[F.percentile_approx(F.when(F.col("bad"), F.col(n)), at, 2000).alias(f"{n}_bad") for n in names]).first()
    cuts = {n: sorted(set(found[n] or []) | set(found[f"{n}_bad"] or [])) for n in names}
    if not any(cuts.values()):
        return []
    below = lambda n: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[n]]), lambda c: c < F.col(n)))
    counted = rows.select("bad", "growing", F.array(*[below(n) for n in names]).alias("bins")).groupBy("bad", "growing", "bins").count().collect()
    growing, held = [x for x in counted if x["growing"]], [x for x in counted if not x["growing"]]
    place = {n: i for i, n in enumerate(names)}

    def meets(x, rule: list[Condition]) -> bool:
        return all((x["bins"][place[c.measure]] > cuts[c.measure].index(c.cut)) == c.above for c in rule)

    def hits(of: list, rule: list[Condition]) -> tuple[int, int]:
        """(bad, all) that meet the rule."""
        met = [x for x in of if meets(x, rule)]
        return sum(x["count"] for x in met if x["bad"]), sum(x["count"] for x in met)

    rules: list[list[Condition]] = []
    while len(rules) < RULES:
        rule: list[Condition] = []
        left = growing
        while len(rule) < CONDITIONS:
            good_all, bad_all = (sum(x["count"] for x in left if x["bad"] == side) for side in (False, True))
            if not good_all or not bad_all:
                break
            prior = math.log(bad_all / (bad_all + good_all))
            tried: list[tuple[float, int, Condition]] = []
            for n in names:
                h = [[0, 0] for _ in range(len(cuts[n]) + 1)]
                for x in left:
                    h[x["bins"][place[n]]][x["bad"]] += x["count"]
                good, bad = 0, 0
                for i, cut in enumerate(cuts[n]):
                    good, bad = good + h[i][0], bad + h[i][1]
                    for above, g, b in ((False, good, bad), (True, good_all - good, bad_all - bad)):
                        if b and (gain := b * (math.log((b + 1e-3) / (b + g + 1e-3)) - prior)) > 1e-9:
                            tried.append((gain, b + g, Condition(n, above, float(cut))))
            if not tried:
                break
            best = max(tried, key=lambda x: x[0])
            near = [x for x in tried if x[0] >= NEAR * best[0] and (x[2].measure, x[2].above) == (best[2].measure, best[2].above)]
            rule.append(min(near, key=lambda x: x[1])[2])
            left = [x for x in left if meets(x, rule[-1:])]
        if not rule:
            break
        score = [(bad + 1) / (n + 2) for bad, n in (hits(held, rule[: k + 1]) for k in range(len(rule)))]
        rule = rule[: max(range(len(rule)), key=lambda k: (score[k], -k)) + 1]
        bad, n = hits(held, rule)
        if n < COVER or bad / n < PRECISION:
            break
        rules.append(rule)
        growing, held = [x for x in growing if not meets(x, rule)], [x for x in held if not meets(x, rule)]
    return rules


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of at most FIT_ROWS labelled documents with bad and growing; a document labelled both ways is bad."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text")).join(F.broadcast(picked), "doc_id")
    rows = own.select("doc_id", "bad", (fold(F.col("doc_id"), 3) != 0).alias("growing"), measures(F.col("text")).alias("m"))
    return rows.select("doc_id", "bad", "growing", *ratios(F.col("m")))


MADE = (*COUNTS, "base_failed", "rule", "kept")


def verdict(text: Column, rules: list[list[Condition]]) -> Column:
    """Struct of MADE for a text: the counts, whether it fails the base limits, the first rule met (or null), kept."""

    def of(m: Column, r: Column) -> Column:
        rule = F.lit(None).cast("int")
        for i, conditions in reversed(list(enumerate(rules, 1))):
            rule = F.when(both(conditions, r), F.lit(i)).otherwise(rule)
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in COUNTS], failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept"))

    return let(measures(text), lambda m: let(F.struct(*ratios(m)), lambda r: of(m, r)))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """docs' columns plus the counts, base_failed, rule (number of the first rule met, null if none) and kept.

    Columns of docs that are named like these, in any case, are replaced. Null and empty texts fail the base limits; extra
    columns pass through; rows are judged each for itself, so repeated rows agree; an empty table gives none.
    """
    (found,) = fresh_names(docs, "verdict")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in MADE]
    return docs.select(*own, verdict(docs["text"], rules).alias(found)).select(*own, f"{found}.*")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judge() all of docs by the rules fitted on those labelled.

    Without labels there are no rules beyond the base limits; labels of null or unknown doc_ids are left out, a doc_id
    labelled both ways is bad, texts under a repeated doc_id share its label.
    """
    return judge(docs, fit(settle(sample(docs, labels), "counts")))


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever their names."""
    rules = fit(settle(sample(docs, labels), "counts"))
    return docs.where(verdict(docs["text"], rules)["kept"])
