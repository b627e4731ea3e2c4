"""Rules, scores and plans of picture evidence as DataFrame expressions, each with a check written apart from it.

The functions at the top take any relation with the columns they name; the queries below apply them to relations made of
the driver tables, and ORACLES says in plain DuckDB SQL, from the rules' wording and not from the code, what must come out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grid
from ..operators.metadata import EDITORS, edited
from ..sources.tables import raster, table
from .book import K, for_duckdb, on_spark

# ---- fixed values ----

DAMAGE_TYPES = (
    "rectangle_mask", "noise", "zone_deletion", "combined", "bar", "local_blur", "shift_region", "block_dropout", "jpeg_block_artifacts", "mixed",
    "scratch_lines", "large_deleted_square", "multiple_bars", "random_holes", "local_noise",
)
LEVELS = [
    (10, "very_low", "rectangle_mask", False, True), (20, "low", "bar", False, True), (35, "moderate", "zone_deletion", False, True), (50, "moderate_plus", "local_blur", False, True),
    (65, "high", "jpeg_block_artifacts", True, True), (80, "very_high", "block_dropout", True, False), (100, "extreme", "mixed", True, False),
]
STRATEGIES = {
    "inpainting": ("inpainting_r3", "inpainting_r5", "inpainting_r7"),
    "patchmatch": ("patchmatch_p7_i5", "patchmatch_p9_i5", "patchmatch_p11_i7"),
    "denoise": ("denoise_median_blur", "denoise_gaussian_blur", "denoise_bilateral"),
    "deblur": ("deblur_light", "deblur_strong"),
    "block_repair": ("block_repair",),
    "composite": ("denoise_then_inpaint", "inpaint_then_sharpen", "deblur_then_inpaint", "block_then_inpaint", "mask_dilate_inpaint", "multi_pass_inpaint"),
    "hybrid": ("hybrid_denoise_inpaint",),
}
FAMILY_ORDER = {
    "inpainting": ("inpainting", "composite", "hybrid", "patchmatch", "denoise", "deblur", "block_repair"),
    "denoise": ("denoise", "composite", "inpainting", "patchmatch", "deblur", "block_repair"),
    "deblur": ("deblur", "composite", "denoise", "inpainting", "patchmatch", "block_repair"),
    "block_repair": ("block_repair", "deblur", "composite", "denoise", "inpainting", "patchmatch"),
    "hybrid": ("hybrid", "composite", "inpainting", "patchmatch", "denoise", "deblur", "block_repair"),
}
REGION_PLAN = {
    "strong_edges": ("criminisi_p9", "criminisi_p15", "inpainting_r3"),
    "textured": ("patchmatch_p11", "criminisi_p15", "patchmatch_p9"),
    "homogeneous": ("inpainting_r7", "inpainting_r5", "criminisi_p9"),
}
FORCED_PHASES = ("task_started", "task_completed", "task_failed", "strategy_completed")
RETENTION_HOURS = {"input": 24, "corrupted": 48, "reconstructed": 48, "masks": 48, "analyses": 168}
OPEN_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp")
OPEN_FOLDERS = ("/data/corrupted/", "/data/reconstructed/", "/data/masks/", "/data/input/", "/data/extracted/", "/data/reports/")
SSIM_WINDOW, PAD = 7, 8


# ---- expressions ----


def recommended(kind: Column, confidence: Column) -> Column:
    """The repair family for a type of damage; inpainting only from confidence 0.40 on."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(kind.isin("mask_like", "missing", "zone_deletion", "bar", "multiple_bars", "large_deleted_square", "random_holes", "scratch_lines") & (confidence >= 0.40), "inpainting")
        .when(kind.isin("noise_like", "noise", "local_noise"), "denoise")
        .when(kind.isin("blur", "blur_like", "local_blur"), "deblur")
        .when(kind.isin("jpeg_block", "jpeg_block_artifacts", "blocky"), "block_repair")
        .when(kind.isin("mixed", "combined", "shift_region", "block_dropout"), "hybrid")
        .otherwise("conservative")
    )


def level_of(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value.cast("int")))


def profile(level: Column) -> Column:
    """Struct (label, corruption_type, imperfect_mask, use_mask) of a level from 0 to 100."""
    make = lambda r: F.struct(F.lit(r[1]).alias("label"), F.lit(r[2]).alias("corruption_type"), F.lit(r[3]).alias("imperfect_mask"), F.lit(r[4]).alias("use_mask"))
    out = make(LEVELS[-1])
    for r in reversed(LEVELS[:-1]):
        out = F.when(level <= r[0], make(r)).otherwise(out)
    return out


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds to decimal, south and west negative, 6 places half-even."""
    return F.bround((d + m / 60 + s / 3600) * F.when(ref.isin("S", "W"), -1.0).otherwise(1.0), 6)


def path_status(path: Column) -> Column:
    """HTTP status of a request for a file: the suffix first, then where its `..` lead to; 200 where both are allowed."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    climb = path
    for _ in range(4):
        climb = F.regexp_replace(climb, r"/(?!\.\./)[^/]+/\.\./", "/")
    inside = F.exists(F.array(*[F.lit(x) for x in OPEN_FOLDERS]), lambda x: F.startswith(climb, x))
    return F.when(~suffix.isin(*OPEN_SUFFIXES), 403).when(~inside | F.contains(climb, F.lit("/../")), 403).otherwise(200)


def header_verdict(content: Column, formats: tuple[str, ...] = ("JPEG",)) -> DataFrame:
    """Struct (valid, reason, format, width, height) of the bytes of a BMP, PNG or JPEG start: the first check that fails.

    readable, then dimensions above 0, then an allowed format. JPEG sizes stand in a frame header behind tables, so only
    BMP and PNG have theirs read here.
    """
    head = lambda n: F.hex(F.substring(content, 1, n))
    little = lambda at: F.conv(F.concat(*[F.hex(F.substring(content, at + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    big = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    form = F.when(head(2) == "424D", "BMP").when(head(8) == "89504E470D0A1A0A", "PNG").when(head(3) == "FFD8FF", "JPEG")
    size = F.octet_length(content)
    whole = F.when(form == "BMP", (size >= 26) & (little(3) == size)).when(form == "PNG", size >= 33).otherwise(True)
    width = F.when(form == "BMP", little(19)).when(form == "PNG", big(17))
    height = F.when(form == "BMP", little(23)).when(form == "PNG", big(21))
    reason = F.when(form.isNull() | ~whole, "unreadable").when((width <= 0) | (height <= 0), "dimensions").when(~form.isin(*formats), "format")
    return F.struct(reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"), form.alias("format"), width.alias("width"), height.alias("height"))


# ---- relations ----


def window_sums(pixels: DataFrame, keys: list[str], window: int, pairs: list[tuple[str, str]], *more: str) -> DataFrame:
    """keys, y, x, the columns of pairs and `more`, and the sums over windows that alike() needs; _n counts a window's pixels."""
    used = sorted({c for pair in pairs for c in pair})
    value = {c: F.col(c).cast("double") for c in used}
    sums = {f"_{c}": value[c] for c in used} | {f"_{c}_{c}": value[c] * value[c] for c in used} | {f"_{a}_{b}": value[a] * value[b] for a, b in pairs} | {"_n": F.lit(1)}
    return grid.box_sums(pixels.select(*keys, "y", "x", *dict.fromkeys([*used, *more])), keys, window // 2, **sums)


def alike(a: str, b: str, window: int) -> Column:
    """Structural similarity of two columns in a whole window of window_sums()."""
    n = window * window
    f, c1, c2 = n / (n - 1), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mean = lambda *c: F.col("_" + "_".join(c)) / n
    va, vb, cov = (f * (mean(x, y) - mean(x) * mean(y)) for x, y in ((a, a), (b, b), (a, b)))
    return (2 * mean(a) * mean(b) + c1) * (2 * cov + c2) / ((mean(a) * mean(a) + mean(b) * mean(b) + c1) * (va + vb + c2))


def ssims(pixels: DataFrame, keys: list[str], window: int = SSIM_WINDOW, **pairs: tuple[str, str]) -> DataFrame:
    """keys and, for each name in pairs, the mean structural similarity of its two columns; uniform windows, in one pass.

    pixels: keys, y, x and the columns, whole rectangles. Sums over windows are differences of running sums. Pictures smaller
    than a window have no row.
    """
    rows = window_sums(pixels, keys, window, list(pairs.values())).where(F.col("_n") == window * window)
    return rows.groupBy(*keys).agg(*[F.avg(alike(*pair, window)).alias(name) for name, pair in pairs.items()])


def ssim(pixels: DataFrame, keys: list[str], a: str, b: str, window: int = SSIM_WINDOW) -> DataFrame:
    """keys, ssim of the columns a and b."""
    return ssims(pixels, keys, window, ssim=(a, b))


def decibels(mse: Column) -> Column:
    return F.when(mse == 0, 100.0).otherwise(10 * F.log10(F.lit(65025.0) / mse))


def supervised(pixels: DataFrame, keys: list[str], **repairs: str) -> DataFrame:
    """Scores of repaired pictures with the original at hand. pixels: keys, y, x, o (original), d (damaged), hit and w (repaired).

    One row a picture: the score from 0 to 100 and what it is made of. Inside the mask's box, PAD pixels wider, structure
    counts the more the smaller the mask is; a box too small for SSIM counts by its RMSE. Where `repairs` names columns,
    each is a repair of its own, and its name the column strategy behind the keys.

    A window that lies in the box is one of the picture's, so all comes from one pass over the pixels and one group; of
    pictures dealt out by their keys (grid.dealt) nothing is moved.
    """
    tried, whole, n = repairs or {None: "w"}, Window.partitionBy(*keys), SSIM_WINDOW * SSIM_WINDOW
    sq = lambda a, b: ((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).cast("double")
    hit, full, reach = F.col("hit"), F.col("_n") == n, SSIM_WINDOW // 2
    rows = window_sums(pixels, keys, SSIM_WINDOW, [("o", c) for c in dict.fromkeys(["d", *tried.values()])], "hit")
    rows = rows.withColumns({f"{c}{i}": f(F.when(hit, F.col(c))).over(whole) for c in ("y", "x") for i, f in enumerate((F.min, F.max))})
    inside = lambda r: F.col("y").between(F.col("y0") - PAD + r, F.col("y1") + PAD - r) & F.col("x").between(F.col("x0") - PAD + r, F.col("x1") + PAD - r)
    measures = {c: {
        "mse": F.avg(sq(c, "o")), "mse_in": F.avg(F.when(hit, sq(c, "o"))), "mse_out": F.avg(F.when(~hit, sq(c, "o"))), "zone_rmse": F.greatest(F.lit(0.0), 1 - F.sqrt(F.avg(F.when(inside(0), sq(c, "o")))) / 255),
        "ssim": F.avg(F.when(full, alike("o", c, SSIM_WINDOW))), "zone": F.avg(F.when(full & inside(reach), alike("o", c, SSIM_WINDOW))),
    } for c in dict.fromkeys(tried.values())}
    same = {"mse_d": F.avg(sq("d", "o")), "mse_out_d": F.avg(F.when(~hit, sq("d", "o"))), "coverage": F.avg(hit.cast("double")), "ssim_d": F.avg(F.when(full, alike("o", "d", SSIM_WINDOW))), "boxed": F.max("y1").isNotNull()}
    rows = rows.groupBy(*keys).agg(*[m.alias(k) for k, m in same.items()], *[F.struct(*[m.alias(k) for k, m in of.items()]).alias(f"_{c}") for c, of in measures.items()])
    if repairs:
        each = F.explode(F.array(*[F.struct(F.lit(name).alias("strategy"), F.col(f"_{c}").alias("m")) for name, c in tried.items()]))
        rows = rows.select(*keys, *same, each.alias("e")).select(*keys, "e.strategy", *same, "e.m.*")
        keys = [*keys, "strategy"]
    else:
        rows = rows.select(*keys, *same, "_w.*")
    rows = rows.withColumns({"psnr": decibels(F.col("mse")), "psnr_d": decibels(F.col("mse_d")), "zone_ssim": F.when(F.col("boxed"), F.coalesce("zone", "zone_rmse"))})
    rows = rows.withColumns({"gain_psnr": F.col("psnr") - F.col("psnr_d"), "gain_ssim": F.col("ssim") - F.col("ssim_d")})
    weight = F.greatest(F.lit(0.3), F.lit(0.8) - F.col("coverage") * 2)
    structure = F.when(F.col("zone_ssim").isNull(), F.col("ssim")).otherwise((1 - weight) * F.col("ssim") + weight * F.col("zone_ssim"))
    score = structure * 60 + F.least("psnr", F.lit(100.0)) * 0.2 + F.greatest(F.lit(0.0), F.col("gain_ssim")) * 30 + F.greatest(F.lit(0.0), F.col("gain_psnr")) * 0.2
    return rows.select(
        *keys, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"), "psnr", "ssim", "zone_ssim", "gain_psnr", "gain_ssim",
        (F.greatest(F.lit(0.0), 1 - F.sqrt("mse_in") / 255) * 100).alias("mask_region_score"), (F.greatest(F.lit(0.0), 1 - F.col("mse_out") / 65025) * 100).alias("outside_score"),
        F.greatest(F.lit(0.0), 1 - F.col("mse_out") / F.greatest("mse_out_d", F.lit(1e-6))).alias("outside_preservation"),
    )


def copied_blocks(pixels: DataFrame, size: int, least_distance: float) -> DataFrame:
    """image_id, y, x, from_y, from_x of blocks of size x size that repeat an earlier one of the picture at a distance.

    Blocks are gathered by windows along rows, then columns, and hashed; each is linked to the one before it, in reading
    order, with the same content, so a flat picture costs as many links as it has blocks. Flat blocks say nothing.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(0, size - 1), Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(0, size - 1)
    blocks = pixels.withColumn("across", F.collect_list("v").over(row)).where(F.size("across") == size)
    blocks = blocks.withColumn("block", F.flatten(F.collect_list("across").over(column))).where(F.size("block") == size * size).where(F.array_min("block") < F.array_max("block"))
    before = Window.partitionBy("image_id", F.sha2(F.array_join("block", ","), 256)).orderBy("y", "x")
    linked = blocks.withColumn("prior", F.lag(F.struct("y", "x")).over(before))
    near = F.sqrt((F.col("y") - F.col("prior.y")) ** 2 + (F.col("x") - F.col("prior.x")) ** 2)
    return linked.where(near >= least_distance).select("image_id", "y", "x", F.col("prior.y").alias("from_y"), F.col("prior.x").alias("from_x"))


def throttled(events: DataFrame, gap: float = 30.0) -> DataFrame:
    """Rows of (task, seconds, seq, phase) that are logged: forced phases, and others `gap` seconds after the last logged.

    What is logged depends on what was, so rows stream through in order, a task's state carried from batch to batch; no
    task is gathered.
    """
    names = ["task", "seconds", "seq", "phase"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last = None, 0.0
        for batch in batches:
            keep = []
            for r in batch.itertuples(index=False):
                if r.task != task:
                    task, last = r.task, 0.0
                go = r.phase in FORCED_PHASES or r.seconds - last >= gap
                last = r.seconds if go else last
                keep.append(go)
            yield batch[keep]

    rows = events.select(*names).repartition("task").sortWithinPartitions("task", "seconds", "seq")
    return rows.mapInPandas(run, rows.schema)


# ---- queries ----


def damaged_types(spark, sf_dir):
    """events with a type of damage, of any case and padding, and a confidence."""
    kinds = (*DAMAGE_TYPES, "mask_like", "missing", "noise_like", "blur", "blocky", "unknown", "")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), ((F.col("event_id") % 101) / 100).alias("confidence"))


KINDS_SQL = "(SELECT event_id, (['rectangle_mask','noise','zone_deletion','combined','bar','local_blur','shift_region','block_dropout','jpeg_block_artifacts','mixed','scratch_lines','large_deleted_square','multiple_bars','random_holes','local_noise','mask_like','missing','noise_like','blur','blocky','unknown',''])[event_id % 22 + 1] AS kind, (event_id % 101) / 100.0 AS confidence FROM events)"


def type_whitelist(spark, sf_dir):
    rows = damaged_types(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.upper("kind")).otherwise(F.concat(F.lit("  "), "kind", F.lit(" "))).alias("given"))
    return rows.select("event_id", F.trim("given").alias("given"), F.lower(F.trim("given")).isin(*DAMAGE_TYPES).alias("allowed"))


def recommended_strategy(spark, sf_dir):
    return damaged_types(spark, sf_dir).select("event_id", recommended(F.upper("kind"), F.col("confidence")).alias("strategy"))


def level_profile(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", level_of(F.col("value") - 20).cast("long").alias("level")).select("event_id", "level", profile(F.col("level")).alias("p")).select("event_id", "level", "p.*")


def plan_rows(spark, exhaustive: bool) -> DataFrame:
    """recommended, place, strategy, family: the whole order of each recommendation, from two small dimension tables."""
    families = spark.createDataFrame([(r, f, i) for r, fs in FAMILY_ORDER.items() for i, f in enumerate(fs)], "recommended string, at string, family_place int")
    steps = [(f, s, f, i) for f, ss in STRATEGIES.items() for i, s in enumerate(ss)]
    if exhaustive:
        steps += [("patchmatch", "patchmatch_p15_i20", "patchmatch", 90), ("inpainting", "criminisi_p9", "criminisi", 91), ("inpainting", "criminisi_p15", "criminisi", 92), ("end", "meta_regional", "meta_regional", 0)]
        families = families.unionByName(families.select("recommended").distinct().select("recommended", F.lit("end").alias("at"), F.lit(99).alias("family_place")))
    steps = spark.createDataFrame(steps, "at string, strategy string, family string, step int")
    place = F.row_number().over(Window.partitionBy("recommended").orderBy("family_place", "step"))
    return families.join(steps, "at").select("recommended", place.cast("long").alias("place"), "strategy", "family")


def recommended_pictures(spark, sf_dir) -> DataFrame:
    """vec_id, recommended: what is advised for the type of damage that each picture stands for; conservative ones have no plan."""
    kind = F.element_at(F.array(*[F.lit(k) for k in DAMAGE_TYPES]), (F.col("vec_id") % len(DAMAGE_TYPES) + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", recommended(kind, F.lit(1.0)).alias("recommended"))


def picture_plans(spark, sf_dir, exhaustive: bool) -> DataFrame:
    return recommended_pictures(spark, sf_dir).join(F.broadcast(plan_rows(spark, exhaustive)), "recommended").select("vec_id", "recommended", "place", "strategy", "family")


def adaptive_plan(spark, sf_dir):
    """The strategies tried on each picture, in order."""
    return picture_plans(spark, sf_dir, False)


def exhaustive_plan(spark, sf_dir):
    return picture_plans(spark, sf_dir, True)


def legal_methods(spark, sf_dir):
    """Every strategy of each picture's exhaustive plan, and a generative one for every seventh, with what it is worth as evidence."""
    generative = table(spark, sf_dir, "embeddings").where("vec_id % 7 = 0").select("vec_id", F.lit("lama_big").alias("strategy"))
    name = F.lower("strategy")
    rows = picture_plans(spark, sf_dir, True).select("vec_id", "strategy").unionByName(generative)
    return rows.select("vec_id", "strategy", (~F.contains(name, F.lit("patchmatch")) & ~F.contains(name, F.lit("lama"))).alias("forensic_safe"), F.when(F.contains(name, F.lit("lama")), "generative").otherwise("forensic_safe").alias("mode"))


#: Pictures are dealt out whole, before they are pixels.
FILLS = on_spark(f"WITH {K} SELECT vec_id, y, x, o, v AS d, hit, row_mean, global_mean, box_mean FROM fill", lambda spark, sf_dir, name: grid.dealt(table(spark, sf_dir, name), ["vec_id"], grid.PART // 64))


def scored(spark, sf_dir):
    """The scores of four repairs of each vector's picture, side by side in its pixels' rows: nothing, and three means."""
    mended = lambda *means: F.when(F.col("hit"), F.coalesce(*means, F.lit(0))).otherwise(F.col("d"))
    means = {"row_mean": mended("row_mean", "global_mean"), "global_mean": mended("global_mean"), "box_mean": mended("box_mean", "global_mean")}
    return supervised(FILLS(spark, sf_dir).withColumns(means), ["vec_id"], conservative="d", **{n: n for n in means})


def supervised_score(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "strategy", *[F.round(c, 5).alias(c) for c in ("score", "psnr", "ssim", "zone_ssim", "mask_region_score", "outside_score", "outside_preservation")])


def recoverability_class(spark, sf_dir):
    gain, s, up = F.round("gain_psnr", 9), F.round("ssim", 9), F.round("gain_ssim", 9) > 0
    verdict = F.when((gain >= 5) & (s >= 0.97) & up, "recoverable").when((gain > 0.5) & (s >= 0.85) & up, "partially_recoverable").otherwise("non_recoverable")
    return scored(spark, sf_dir).select("vec_id", "strategy", verdict.alias("class"))


def improvement_flag(spark, sf_dir):
    gain, more = F.round("gain_psnr", 9), F.round("gain_ssim", 9)
    return scored(spark, sf_dir).select("vec_id", "strategy", (((gain > 1) & (more > 0)) | ((gain > 0) & (more > 0.01))).alias("improved"), F.round(0.7 * F.col("gain_psnr") + 30 * F.col("gain_ssim"), 4).alias("improvement_score"))


def report_labels(spark, sf_dir):
    """Labels and notes of the analysis block, from a score, an IoU and gains that each event stands for."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 101 / 100).alias("iou"), (F.col("event_id") % 97).cast("double").alias("score"), ((F.col("event_id") % 13 - 4) / 2).alias("psnr_gain"), ((F.col("event_id") % 11 - 3) / 32).alias("ssim_gain"))
    e = e.withColumn("improvement", ((F.col("psnr_gain") > 1) & (F.col("ssim_gain") > 0)) | ((F.col("psnr_gain") > 0) & (F.col("ssim_gain") > 0.01))).withColumn("gain", 0.7 * F.col("psnr_gain") + 30 * F.col("ssim_gain"))
    e = e.withColumns({
        "detection_quality": F.when(F.col("iou") >= 0.6, "good").when(F.col("iou") >= 0.3, "medium").otherwise("poor"),
        "repair_effectiveness": F.when(F.col("improvement") & (F.col("gain") > 0), "improved").when(F.abs("gain") < 0.5, "neutral").otherwise("degraded"),
        "score_level": F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "medium").otherwise("poor"),
    })
    notes = F.array_compact(F.array(
        F.when(F.col("detection_quality") == "poor", "imprecise detection"), F.when(F.col("repair_effectiveness") == "degraded", "no measurable gain"),
        F.when((F.col("detection_quality") == "good") & (F.col("repair_effectiveness") == "improved"), "located and improved"), F.when(F.col("psnr_gain") > 3, F.format_string("PSNR gain +%.1f dB", "psnr_gain")),
        F.when(F.col("ssim_gain") > 0.05, "SSIM gain"), F.when(F.col("score_level") == "excellent", "excellent score"),
    ))
    return e.select("event_id", "detection_quality", "repair_effectiveness", "score_level", F.array_join(F.when(F.size(notes) == 0, F.array(F.lit("nothing unusual"))).otherwise(notes), " | ").alias("notes"))


def lsb_anomaly(spark, sf_dir):
    """One channel: entropy and balance of the lowest bits, from stats rounded to four places."""
    p = F.avg((F.col("v") % 2).cast("double"))
    rows = raster(table(spark, sf_dir, "embeddings")).groupBy("vec_id").agg(p.alias("p"))
    eps = 1e-10
    entropy = F.bround(-((1 - F.col("p")) * F.log2(1 - F.col("p") + eps) + F.col("p") * F.log2(F.col("p") + eps)), 4)
    ratio = F.bround("p", 4)
    score = F.round((F.greatest(F.lit(0.0), (entropy - 0.90) / 0.10) + F.greatest(F.lit(0.0), 1 - F.abs(ratio - 0.5) * 20)) / 2, 3)
    rows = rows.select("vec_id", entropy.alias("entropy"), ratio.alias("ratio_ones"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("anomaly_score"))
    return rows.withColumn("suspicious", F.col("anomaly_score") > 0.6).withColumn("level", F.when(F.col("anomaly_score") > 0.75, "high").when(F.col("anomaly_score") > 0.5, "medium").otherwise("low"))


def lsb_stats(spark, sf_dir):
    rows = raster(table(spark, sf_dir, "embeddings"))
    low = [F.bround(F.avg((F.col("v").bitwiseAND(F.lit(7)) == k).cast("double")), 4).alias(f"low_{k}") for k in range(8)]
    return rows.groupBy("vec_id").agg(F.count_if(F.col("v") % 2 == 1).alias("n_ones"), F.count_if(F.col("v") % 2 == 0).alias("n_zeros"), *low)


def copy_move_links(spark, sf_dir):
    pixels = raster(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("image_id"), "y", "x", (F.floor(F.col("v") / 32)).alias("v"))
    return copied_blocks(pixels, 2, 3.0)


def copy_move_verdict(spark, sf_dir):
    found = copy_move_links(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n_matches"))
    return found.select("image_id", "n_matches", F.least(F.lit(1.0), F.col("n_matches") / 50).alias("confidence"), (F.col("n_matches") >= 10).alias("suspicious"))


def throttle_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    phase = F.when(F.col("event_id") % 17 == 0, "strategy_completed").when(F.col("event_id") % 29 == 0, "task_started").otherwise("strategy_running")
    begin = e.groupBy("user_id").agg(F.min("ts").alias("begin"))
    seconds = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("begin").cast("timestamp"))).cast("double") / 3600
    rows = e.join(begin, "user_id").select(F.col("user_id").alias("task"), seconds.alias("seconds"), F.col("event_id").alias("seq"), phase.alias("phase"))
    return throttled(rows, 30.0).select("task", "seq", "phase")


def iterative_refine(spark, sf_dir):
    """Attempts at growing radius, in order: an attempt counts if it beats the best so far by over 0.1; the first that doesn't ends it."""
    tries = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 10 + F.col("l_linenumber"), 4).alias("score"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "score")
    before = F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1))
    failed = F.max(F.when(F.col("best") + 0.1 >= F.col("score"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = tries.withColumn("best", before).withColumn("failed", failed).where("failed = 0")
    return kept.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("accepted"), F.max("score").alias("score"))


def bitmaps(spark, sf_dir) -> DataFrame:
    """BMP files of the 8 x 8 pictures, and among them unreadable, cut, empty and foreign ones: image_id, content."""
    hexed = lambda c, n: F.concat(*[F.substring(F.lpad(F.hex(c), 2 * n, "0"), 2 * i - 1, 2) for i in range(n, 0, -1)])
    rows = raster(table(spark, sf_dir, "embeddings")).groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda q: F.lpad(F.hex(q["v"]), 2, "0")), "").alias("body"))
    width = F.when(F.col("vec_id") % 7 == 3, 0).otherwise(8)
    head = F.concat(F.lit("424D"), hexed(F.lit(54 + 64), 4), F.lit("00000000"), hexed(F.lit(54), 4), hexed(F.lit(40), 4), hexed(width, 4), hexed(F.lit(8), 4), F.lit("01000800"), F.lit("00" * 24))
    file = F.concat(head, "body")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lit("0000000800000008"), "body")
    content = F.when(F.col("vec_id") % 7 == 1, F.concat(F.lit("0000"), file)).when(F.col("vec_id") % 7 == 2, F.substring(file, 1, 200)).when(F.col("vec_id") % 7 == 4, png).otherwise(file)
    return rows.select(F.col("vec_id").alias("image_id"), F.unhex(content).alias("content"))


def verify_image(spark, sf_dir):
    return bitmaps(spark, sf_dir).select("image_id", header_verdict(F.col("content"), ("BMP",)).alias("v")).select("image_id", "v.*")


def first_valid_image(spark, sf_dir):
    """The first valid picture of each dump of ten."""
    found = verify_image(spark, sf_dir).where("valid").withColumn("dump_id", F.floor(F.col("image_id") / 10).cast("long"))
    return found.groupBy("dump_id").agg(F.min("image_id").alias("image_id"), F.count("*").alias("n_valid"))


def fragment_permutations(spark, sf_dir):
    """Texts in four pieces in a wrong order: the first order, of all 24 in turn, in which they are whole again."""
    docs = table(spark, sf_dir, "documents").where("length(text) >= 40").select("doc_id", F.floor(F.length("text") / 4).cast("int").alias("n"), "text")
    cut = [F.substring("text", F.lit(1), F.col("n")), F.substring("text", F.col("n") + 1, F.col("n")), F.substring("text", 2 * F.col("n") + 1, F.col("n")), F.substring("text", 3 * F.col("n") + 1, F.length("text"))]
    docs = docs.select("doc_id", "text", *[c.alias(f"cut_{k}") for k, c in enumerate(cut)])
    # pieces are columns, each used many times, so a text is cut once and not once an order
    turn = lambda *ks: F.when(F.col("doc_id") % 3 == 0, F.col(f"cut_{ks[0]}")).when(F.col("doc_id") % 3 == 1, F.col(f"cut_{ks[1]}")).otherwise(F.col(f"cut_{ks[2]}"))
    rows = docs.select("doc_id", "text", *[turn(*ks).alias(f"piece_{k}") for k, ks in enumerate(zip((2, 0, 3, 1), (1, 0, 2, 3), (3, 2, 1, 0), strict=True), 1)])
    whole = lambda p: F.concat(*[F.col(f"piece_{k}") for k in p]) == F.col("text")
    return rows.select("doc_id", F.coalesce(*[F.when(whole(p), "".join(map(str, p))) for p in itertools.permutations(range(1, 5))]).alias("order"))


def retention_counts(spark, sf_dir):
    """Files older than their folder's age, counted a folder and in all; nothing is deleted."""
    kinds = spark.createDataFrame([(i, k, h) for i, (k, h) in enumerate(RETENTION_HOURS.items())], "k long, folder string, hours int")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))
    old = e.join(now).join(F.broadcast(kinds), "k").where(F.unix_timestamp("now") - F.unix_timestamp("ts") > F.col("hours") * 3600)
    return old.rollup("folder").count().select(F.coalesce("folder", F.lit("total")).alias("category"), F.col("count").alias("n"))


def software_flags(spark, sf_dir):
    names = (*EDITORS, "camera firmware", "Paint.NET 4", "Adobe Photoshop 25", "")
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % len(names) + 1).cast("int")).alias("software"))
    return rows.select("page_id", "software", edited(F.initcap("software")).alias("flagged"))


def dms_decimal(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    ref = F.element_at(F.array(*[F.lit(x) for x in "NSEW"]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return s.select("s_suppkey", degrees((F.col("s_suppkey") % 90).cast("double"), (F.col("s_suppkey") % 60).cast("double"), (F.col("s_suppkey") * 7 % 60).cast("double"), ref).alias("degrees"))


def path_guard(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("/data/input/", "/data/masks/../masks/", "/data/masks/../../etc/", "/tmp/", "/data/reports/a/b/../", "/data/../data/input/")]), (F.col("page_id") % 6 + 1).cast("int"))
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".png", ".exe", "", ".webp")]), (F.col("page_id") % 5 + 1).cast("int")))
    return p.select("page_id", path_status(F.concat(folder, name)).cast("long").alias("status"))


def region_merge(spark, sf_dir):
    """Gray bands of a picture by area, the largest first; all beyond the third are merged into one."""
    areas = raster(table(spark, sf_dir, "embeddings")).groupBy("vec_id", F.floor(F.col("v") / 32).alias("band")).agg(F.count("*").alias("area"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("area"), "band"))
    return areas.withColumn("region", F.least(place, F.lit(4)).cast("long")).groupBy("vec_id", "region").agg(F.sum("area").alias("area"), F.count("*").alias("parts"))


def regional_plan(spark, sf_dir):
    """The three strategies of each picture's kind of region, by its variance and gradient against those of 60 and 70 percent of all."""
    pixels = raster(table(spark, sf_dir, "embeddings"))
    across = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("vec_id", "y").orderBy("x")))
    stats = pixels.withColumn("g", across).groupBy("vec_id").agg(F.var_pop("v").alias("va"), F.avg("g").alias("gr"))
    cut = stats.agg(F.percentile("va", 0.6).alias("va_cut"), F.percentile("gr", 0.7).alias("gr_cut"))
    kind = F.when(F.col("gr") >= F.col("gr_cut"), "strong_edges").when(F.col("va") >= F.col("va_cut"), "textured").otherwise("homogeneous")
    plan = spark.createDataFrame([(k, i + 1, s) for k, ss in REGION_PLAN.items() for i, s in enumerate(ss)], "region_type string, place long, strategy string")
    return stats.join(cut).select("vec_id", kind.alias("region_type")).join(F.broadcast(plan), "region_type").select("vec_id", "region_type", "place", "strategy")


def block_heat(spark, sf_dir):
    """Variance of 4 x 4 blocks from 0 to 1 within the picture; a flat picture is 0."""
    blocks = raster(table(spark, sf_dir, "embeddings")).groupBy("vec_id", F.floor(F.col("y") / 4).alias("block_y"), F.floor(F.col("x") / 4).alias("block_x")).agg(F.var_pop("v").alias("va"))
    whole = Window.partitionBy("vec_id")
    low, high = F.min("va").over(whole), F.max("va").over(whole)
    return blocks.select("vec_id", "block_y", "block_x", F.round(F.coalesce((F.col("va") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), 6).alias("heat"))


def first_n(name: str, n: int):
    rows = {"audit_tail": lambda e: e.select("event_id", "user_id", "event_type", "value", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(n).drop("ts"), "analysis_listing": lambda e: e.groupBy("user_id").agg(F.max("event_id").alias("last_event")).orderBy(F.desc("last_event")).limit(n)}[name]
    return lambda spark, sf_dir: rows(table(spark, sf_dir, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        type_whitelist, recommended_strategy, level_profile, adaptive_plan, exhaustive_plan, legal_methods, supervised_score, recoverability_class, improvement_flag, report_labels, lsb_anomaly, lsb_stats,
        copy_move_links, copy_move_verdict, throttle_events, iterative_refine, verify_image, first_valid_image, fragment_permutations, retention_counts, software_flags, dms_decimal, path_guard, region_merge,
        regional_plan, block_heat,
    )
} | {"audit_tail": first_n("audit_tail", 100), "analysis_listing": first_n("analysis_listing", 50)}

# ---- checks: plain DuckDB ----

PX = "px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(CASE WHEN hi > lo THEN floor((e - lo) / (hi - lo) * 255) ELSE 0 END AS BIGINT) AS v FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS e, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings) q)"
STEPS = """st(family, so, strategy) AS (VALUES ('inpainting', 1, 'inpainting_r3'), ('inpainting', 2, 'inpainting_r5'), ('inpainting', 3, 'inpainting_r7'), ('patchmatch', 1, 'patchmatch_p7_i5'), ('patchmatch', 2, 'patchmatch_p9_i5'), ('patchmatch', 3, 'patchmatch_p11_i7'),
  ('denoise', 1, 'denoise_median_blur'), ('denoise', 2, 'denoise_gaussian_blur'), ('denoise', 3, 'denoise_bilateral'), ('deblur', 1, 'deblur_light'), ('deblur', 2, 'deblur_strong'), ('block_repair', 1, 'block_repair'), ('composite', 1, 'denoise_then_inpaint'),
  ('composite', 2, 'inpaint_then_sharpen'), ('composite', 3, 'deblur_then_inpaint'), ('composite', 4, 'block_then_inpaint'), ('composite', 5, 'mask_dilate_inpaint'), ('composite', 6, 'multi_pass_inpaint'), ('hybrid', 1, 'hybrid_denoise_inpaint')),
od(recommended, families) AS (VALUES ('inpainting', 'inpainting composite hybrid patchmatch denoise deblur block_repair'), ('denoise', 'denoise composite inpainting patchmatch deblur block_repair'), ('deblur', 'deblur composite denoise inpainting patchmatch block_repair'),
  ('block_repair', 'block_repair deblur composite denoise inpainting patchmatch'), ('hybrid', 'hybrid composite inpainting patchmatch denoise deblur block_repair'))"""
ADVICE = """ad AS (SELECT vec_id, CASE WHEN vec_id % 15 IN (2, 4, 10, 11, 12, 13) THEN 'inpainting' WHEN vec_id % 15 IN (1, 14) THEN 'denoise' WHEN vec_id % 15 = 5 THEN 'deblur' WHEN vec_id % 15 = 8 THEN 'block_repair' WHEN vec_id % 15 IN (3, 6, 7, 9) THEN 'hybrid' ELSE 'conservative' END AS recommended FROM embeddings)"""
ALL_STEPS = """fo AS (SELECT recommended, unnest(string_split(families, ' ')) AS family, unnest(range(9)) AS k FROM od),
al AS (SELECT recommended, k, so, strategy, family FROM fo JOIN st USING (family) UNION ALL SELECT recommended, k, 4, 'patchmatch_p15_i20', family FROM fo WHERE family = 'patchmatch'
UNION ALL SELECT recommended, k, 3 + i, 'criminisi_p' || (3 + 6 * i), 'criminisi' FROM fo, range(1, 3) r(i) WHERE family = 'inpainting' UNION ALL SELECT recommended, 100, 1, 'meta_regional', 'meta_regional' FROM od),
pl AS (SELECT recommended, row_number() OVER (PARTITION BY recommended ORDER BY k, so) AS place, strategy, family FROM al)"""
SCORES = for_duckdb(f"WITH {K}") + """,
ce(cy, cx) AS (VALUES (3, 3), (3, 4), (4, 3), (4, 4)),
wi AS (SELECT vec_id, strategy, cy, cx, avg(o) AS uo, avg(w) AS uw, avg(d) AS ud, avg(o * o) AS oo, avg(w * w) AS ww, avg(d * d) AS dd, avg(o * w) AS ow, avg(o * d) AS od
  FROM cand JOIN ce ON abs(y - cy) <= 3 AND abs(x - cx) <= 3 GROUP BY ALL),
ss AS (SELECT vec_id, strategy, avg((2 * uo * uw + 6.5025) * (2 * 49 / 48e0 * (ow - uo * uw) + 58.5225) / ((uo * uo + uw * uw + 6.5025) * (49 / 48e0 * (oo - uo * uo + ww - uw * uw) + 58.5225))) AS s,
  avg((2 * uo * ud + 6.5025) * (2 * 49 / 48e0 * (od - uo * ud) + 58.5225) / ((uo * uo + ud * ud + 6.5025) * (49 / 48e0 * (oo - uo * uo + dd - ud * ud) + 58.5225))) AS sd FROM wi GROUP BY ALL),
ms AS (SELECT vec_id, strategy, avg((w - o) ** 2) AS m, avg((d - o) ** 2) AS md, avg((w - o) ** 2) FILTER (WHERE hit) AS mi, avg((w - o) ** 2) FILTER (WHERE NOT hit) AS mo, avg((d - o) ** 2) FILTER (WHERE NOT hit) AS mod, count(*) FILTER (WHERE hit) / count(*) AS cov FROM cand GROUP BY ALL),
sc AS (SELECT vec_id, strategy, s, sd, mi, mo, mod, cov, CASE WHEN m = 0 THEN 100e0 ELSE 10 * log10(65025 / m) END AS p, CASE WHEN md = 0 THEN 100e0 ELSE 10 * log10(65025 / md) END AS pd FROM ms JOIN ss USING (vec_id, strategy))"""

ORACLES = {
    "type_whitelist": f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(kind) ELSE kind END AS given, event_id % 22 < 15 AS allowed FROM {KINDS_SQL} k",
    "recommended_strategy": f"""SELECT event_id, CASE WHEN kind IN ('zone_deletion', 'bar', 'scratch_lines', 'large_deleted_square', 'multiple_bars', 'random_holes', 'mask_like', 'missing') THEN CASE WHEN event_id % 101 >= 40 THEN 'inpainting' ELSE 'conservative' END
WHEN kind LIKE '%noise%' THEN 'denoise' WHEN kind LIKE '%blur%' THEN 'deblur' WHEN kind IN ('jpeg_block_artifacts', 'blocky') THEN 'block_repair' WHEN kind IN ('combined', 'shift_region', 'block_dropout', 'mixed') THEN 'hybrid' ELSE 'conservative' END AS strategy FROM {KINDS_SQL} k""",
    "level_profile": """SELECT event_id, level, label, corruption_type, imperfect_mask, use_mask FROM (SELECT event_id, CAST(trunc(least(100, greatest(0, value - 20))) AS BIGINT) AS level FROM events) e JOIN
(VALUES (0, 10, 'very_low', 'rectangle_mask', false, true), (11, 20, 'low', 'bar', false, true), (21, 35, 'moderate', 'zone_deletion', false, true), (36, 50, 'moderate_plus', 'local_blur', false, true), (51, 65, 'high', 'jpeg_block_artifacts', true, true),
(66, 80, 'very_high', 'block_dropout', true, false), (81, 100, 'extreme', 'mixed', true, false)) p(lo, hi, label, corruption_type, imperfect_mask, use_mask) ON level BETWEEN lo AND hi""",
    "adaptive_plan": f"WITH {STEPS}, {ADVICE}, fo AS (SELECT recommended, unnest(string_split(families, ' ')) AS family, unnest(range(9)) AS k FROM od), pl AS (SELECT recommended, row_number() OVER (PARTITION BY recommended ORDER BY k, so) AS place, strategy, family FROM fo JOIN st USING (family)) SELECT vec_id, recommended, place, strategy, family FROM ad JOIN pl USING (recommended)",
    "exhaustive_plan": f"WITH {STEPS}, {ADVICE}, {ALL_STEPS} SELECT vec_id, recommended, place, strategy, family FROM ad JOIN pl USING (recommended)",
    "legal_methods": f"WITH {STEPS}, {ADVICE}, {ALL_STEPS} SELECT vec_id, strategy, strategy NOT LIKE 'patchmatch%' AS forensic_safe, 'forensic_safe' AS mode FROM ad JOIN pl USING (recommended) UNION ALL SELECT vec_id, 'lama_big', false, 'generative' FROM embeddings WHERE vec_id % 7 = 0",
    "supervised_score": SCORES + """ SELECT vec_id, strategy, round(least(100, greatest(0, 60 * s + p / 5 + 30 * greatest(0, s - sd) + greatest(0, p - pd) / 5)), 5) AS score, round(p, 5) AS psnr, round(s, 5) AS ssim, round(s, 5) AS zone_ssim,
round(100 * greatest(0, 1 - sqrt(mi) / 255), 5) AS mask_region_score, round(100 * greatest(0, 1 - mo / 65025), 5) AS outside_score, round(greatest(0, 1 - mo / greatest(mod, 1e-6)), 5) AS outside_preservation FROM sc""",
    "recoverability_class": SCORES + """ SELECT vec_id, strategy, CASE WHEN round(s - sd, 9) <= 0 THEN 'non_recoverable' WHEN round(p - pd, 9) >= 5 AND round(s, 9) >= 0.97 THEN 'recoverable' WHEN round(p - pd, 9) > 0.5 AND round(s, 9) >= 0.85 THEN 'partially_recoverable' ELSE 'non_recoverable' END AS class FROM sc""",
    "improvement_flag": SCORES + """ SELECT vec_id, strategy, (round(p - pd, 9) > 1 AND round(s - sd, 9) > 0) OR (round(p - pd, 9) > 0 AND round(s - sd, 9) > 0.01) AS improved, round(0.7 * (p - pd) + 30 * (s - sd), 4) AS improvement_score FROM sc""",
    "report_labels": """WITH e AS (SELECT event_id, event_id % 101 AS iou, event_id % 97 AS score, (event_id % 13 - 4) / 2.0 AS pg, (event_id % 11 - 3) / 32.0 AS sg FROM events),
l AS (SELECT *, CASE WHEN iou >= 60 THEN 'good' WHEN iou >= 30 THEN 'medium' ELSE 'poor' END AS q, CASE WHEN ((pg > 1 AND sg > 0) OR (pg > 0 AND sg > 0.01)) THEN 'improved' WHEN abs(0.7 * pg + 30 * sg) < 0.5 THEN 'neutral' ELSE 'degraded' END AS r,
CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'medium' ELSE 'poor' END AS lv FROM e)
SELECT event_id, q AS detection_quality, r AS repair_effectiveness, lv AS score_level, coalesce(nullif(concat_ws(' | ', CASE WHEN q = 'poor' THEN 'imprecise detection' END, CASE WHEN r = 'degraded' THEN 'no measurable gain' END, CASE WHEN q = 'good' AND r = 'improved' THEN 'located and improved' END,
CASE WHEN pg > 3 THEN 'PSNR gain +' || printf('%.1f', CAST(pg AS DOUBLE)) || ' dB' END, CASE WHEN sg > 0.05 THEN 'SSIM gain' END, CASE WHEN lv = 'excellent' THEN 'excellent score' END), ''), 'nothing unusual') AS notes FROM l""",
    "lsb_anomaly": f"""WITH {PX}, s AS (SELECT vec_id, sum(v & 1) / 64e0 AS p FROM px GROUP BY vec_id), t AS (SELECT vec_id, round_even(-((1 - p) * log2(1 - p + 1e-10) + p * log2(p + 1e-10)), 4) AS entropy, round_even(p, 4) AS ratio_ones FROM s),
u AS (SELECT *, least(1, round((greatest(0, (entropy - 0.9e0) * 10) + greatest(0, 1 - 20 * abs(ratio_ones - 0.5e0))) / 2, 3)) AS anomaly_score FROM t)
SELECT vec_id, entropy, ratio_ones, anomaly_score, anomaly_score > 0.6 AS suspicious, CASE WHEN anomaly_score > 0.75 THEN 'high' WHEN anomaly_score > 0.5 THEN 'medium' ELSE 'low' END AS level FROM u""",
    "lsb_stats": f"WITH {PX} SELECT vec_id, count(*) FILTER (WHERE v % 2 = 1) AS n_ones, count(*) FILTER (WHERE v % 2 = 0) AS n_zeros, " + ", ".join(f"round_even(count(*) FILTER (WHERE v % 8 = {k}) / 64e0, 4) AS low_{k}" for k in range(8)) + " FROM px GROUP BY vec_id",
    "copy_move_links": f"""WITH {PX}, q AS (SELECT vec_id, y, x, v // 32 AS v FROM px), b AS (SELECT a.vec_id, a.y, a.x, [a.v, r.v, d.v, z.v] AS k FROM q a JOIN q r ON r.vec_id = a.vec_id AND r.y = a.y AND r.x = a.x + 1 JOIN q d ON d.vec_id = a.vec_id AND d.y = a.y + 1 AND d.x = a.x JOIN q z ON z.vec_id = a.vec_id AND z.y = a.y + 1 AND z.x = a.x + 1),
p AS (SELECT vec_id, y, x, max(y * 8 + x) OVER (PARTITION BY vec_id, k ORDER BY y * 8 + x ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS o FROM b WHERE list_min(k) < list_max(k))
SELECT vec_id AS image_id, y, x, o // 8 AS from_y, o % 8 AS from_x FROM p WHERE o IS NOT NULL AND (y - o // 8) ** 2 + (x - o % 8) ** 2 >= 9""",
    "throttle_events": """WITH RECURSIVE e AS (SELECT user_id AS task, event_id AS seq, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', min(ts) OVER (PARTITION BY user_id))) AS BIGINT) / 3600e0 AS t, event_id % 17 = 0 OR event_id % 29 = 0 AS forced FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY t, seq) AS k FROM e),
w AS (SELECT task, seq, t, k, forced OR t >= 30 AS logged, CASE WHEN forced OR t >= 30 THEN t ELSE 0e0 END AS last FROM n WHERE k = 1
UNION ALL SELECT n.task, n.seq, n.t, n.k, n.forced OR n.t - w.last >= 30, CASE WHEN n.forced OR n.t - w.last >= 30 THEN n.t ELSE w.last END FROM w JOIN n ON n.task = w.task AND n.k = w.k + 1)
SELECT task, seq, CASE WHEN seq % 17 = 0 THEN 'strategy_completed' WHEN seq % 29 = 0 THEN 'task_started' ELSE 'strategy_running' END AS phase FROM w WHERE logged""",
    "iterative_refine": """WITH RECURSIVE n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k, round(l_quantity / 10 + l_linenumber, 4) AS s FROM lineitem),
w AS (SELECT * FROM n WHERE k = 1 UNION ALL SELECT n.* FROM w JOIN n ON n.l_orderkey = w.l_orderkey AND n.k = w.k + 1 WHERE n.s > w.s + 0.1)
SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS accepted, max(s) AS score FROM w GROUP BY l_orderkey""",
    "verify_image": """SELECT vec_id AS image_id, vec_id % 7 IN (0, 5, 6) AS valid, CASE vec_id % 7 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'dimensions' WHEN 4 THEN 'format' ELSE 'ok' END AS reason,
CASE vec_id % 7 WHEN 1 THEN NULL WHEN 4 THEN 'PNG' ELSE 'BMP' END AS format, CASE vec_id % 7 WHEN 1 THEN NULL WHEN 3 THEN 0 ELSE 8 END AS width, CASE vec_id % 7 WHEN 1 THEN NULL ELSE 8 END AS height FROM embeddings""",
    "first_valid_image": "SELECT vec_id // 10 AS dump_id, min(vec_id) AS image_id, count(*) AS n_valid FROM embeddings WHERE vec_id % 7 NOT IN (1, 2, 3, 4) GROUP BY 1",
    "fragment_permutations": """WITH p AS (SELECT doc_id, text, length(text) // 4 AS n FROM documents WHERE length(text) >= 40), c AS (SELECT doc_id, text, substr(text, 1, n) AS a, substr(text, n + 1, n) AS b, substr(text, 2 * n + 1, n) AS c, substr(text, 3 * n + 1) AS d FROM p),
t AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN [c, a, d, b] WHEN 1 THEN [b, a, c, d] ELSE [d, c, b, a] END AS f FROM c), o AS (SELECT i, j, k, 10 - i - j - k AS l FROM range(1, 5) x(i), range(1, 5) y(j), range(1, 5) z(k) WHERE i <> j AND i <> k AND j <> k)
SELECT doc_id, CAST(min(i * 1000 + j * 100 + k * 10 + l) AS VARCHAR) AS "order" FROM t, o WHERE f[i] || f[j] || f[k] || f[l] = text GROUP BY doc_id""",
    "retention_counts": """WITH a AS (SELECT (['input', 'corrupted', 'reconstructed', 'masks', 'analyses'])[user_id % 5 + 1] AS category, epoch(date_trunc('second', max(ts) OVER ())) - epoch(date_trunc('second', ts)) AS age FROM events), o AS (SELECT category FROM a WHERE age > CASE category WHEN 'input' THEN 86400 WHEN 'analyses' THEN 604800 ELSE 172800 END)
SELECT category, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM o""",
    "software_flags": """SELECT page_id, (['photoshop', 'gimp', 'lightroom', 'affinity', 'pixelmator', 'capture one', 'darktable', 'rawtherapee', 'luminar', 'dall-e', 'stable diffusion', 'midjourney', 'firefly', 'topaz', 'imagemagick', 'paint.net', 'camera firmware', 'Paint.NET 4', 'Adobe Photoshop 25', ''])[page_id % 20 + 1] AS software, page_id % 20 NOT IN (16, 19) AS flagged FROM pages""",
    "dms_decimal": "SELECT s_suppkey, round_even((s_suppkey % 90 + (s_suppkey % 60) / 60e0 + (s_suppkey * 7 % 60) / 3600e0) * CASE WHEN s_suppkey % 4 IN (1, 3) THEN -1 ELSE 1 END, 6) AS degrees FROM supplier",
    "path_guard": "SELECT page_id, CAST(CASE WHEN page_id % 5 IN (2, 3) OR page_id % 6 IN (2, 3) THEN 403 ELSE 200 END AS BIGINT) AS status FROM pages",
    "region_merge": f"WITH {PX}, a AS (SELECT vec_id, v // 32 AS b, count(*) AS n FROM px GROUP BY ALL), r AS (SELECT vec_id, n, rank() OVER (PARTITION BY vec_id ORDER BY n DESC, b) AS k FROM a) SELECT vec_id, CASE WHEN k > 3 THEN 4 ELSE k END AS region, CAST(sum(n) AS BIGINT) AS area, count(*) AS parts FROM r GROUP BY ALL",
    "regional_plan": f"""WITH {PX}, g AS (SELECT a.vec_id, avg(abs(b.v - a.v)) AS gr FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.vec_id), s AS (SELECT vec_id, var_pop(v) AS va, any_value(gr) AS gr FROM px JOIN g USING (vec_id) GROUP BY vec_id),
c AS (SELECT quantile_cont(va, 0.6) AS vc, quantile_cont(gr, 0.7) AS gc FROM s), k AS (SELECT vec_id, CASE WHEN gr >= gc THEN 'strong_edges' WHEN va >= vc THEN 'textured' ELSE 'homogeneous' END AS region_type FROM s, c)
SELECT vec_id, region_type, CAST(place AS BIGINT) AS place, strategy FROM k JOIN (VALUES ('strong_edges', 1, 'criminisi_p9'), ('strong_edges', 2, 'criminisi_p15'), ('strong_edges', 3, 'inpainting_r3'), ('textured', 1, 'patchmatch_p11'), ('textured', 2, 'criminisi_p15'), ('textured', 3, 'patchmatch_p9'),
('homogeneous', 1, 'inpainting_r7'), ('homogeneous', 2, 'inpainting_r5'), ('homogeneous', 3, 'criminisi_p9')) p(region_type, place, strategy) USING (region_type)""",
    "block_heat": f"WITH {PX}, b AS (SELECT vec_id, y // 4 AS block_y, x // 4 AS block_x, var_pop(v) AS va FROM px GROUP BY ALL), l AS (SELECT vec_id, min(va) AS lo, max(va) AS hi FROM b GROUP BY vec_id) SELECT vec_id, block_y, block_x, round(CASE WHEN hi > lo THEN (va - lo) / (hi - lo) ELSE 0 END, 6) AS heat FROM b JOIN l USING (vec_id)",
    "audit_tail": "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "analysis_listing": "SELECT user_id, max(event_id) AS last_event FROM events GROUP BY user_id ORDER BY 2 DESC LIMIT 50",
}
ORACLES["copy_move_verdict"] = f"SELECT image_id, count(*) AS n_matches, least(1e0, count(*) / 50e0) AS confidence, count(*) >= 10 AS suspicious FROM ({ORACLES['copy_move_links']}) l GROUP BY image_id"
