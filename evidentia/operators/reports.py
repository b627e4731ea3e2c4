"""Reports of repair runs as nested columns: sections, slim candidates, analysis, chain of custody, legal form; JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reports.
SLIM = ("strategy", "path", "score", "psnr", "ssim", "gain_psnr", "gain_ssim", "mode")
STEPS = (("1_original", "image received", "reception"), ("2_corrupted", "image after simulated damage", "corruption_appliquee"), ("3_reconstructed", "image reconstructed by algorithm", "reconstruction_algorithmique"))
DETECTION, LEVELS = ((0.6, "good"), (0.3, "medium")), ((80, "excellent"), (60, "good"), (40, "medium"))
GENERATIVE, NOT_FORENSIC = "lama", ("patchmatch", "lama")
LEGAL_VERSION = "1.0-legal"
NOTE = "The reconstruction suggests a visual hypothesis that fits its surroundings, without certainty as evidence."
DISCLAIMER = "This report was made by an automatic system. Its results are visual hypotheses of algorithms and no evidence by themselves; they don't replace the judgement of a qualified expert."
WARNINGS = {True: "This result is generative and no forensic evidence.", False: "Algorithmic reconstruction: a visual hypothesis only."}
CERTIFICATIONS = {"probatoire": False, "expertise_humaine_requise": True, "methode_reproductible": True, "open_source": True}

RUN = """run_key string, source_image string, status string, at string, corruption struct<type:string,parameters:map<string,string>,image_path:string,mask_path:string,randomize:boolean,imperfect_mask:boolean>,
before struct<psnr:double,ssim:double>, after struct<psnr:double,ssim:double>, gains struct<psnr_gain:double,ssim_gain:double,improvement_score:double>, improvement boolean, detection struct<iou:double,precision:double,recall:double>, recommended string, extra map<string,string>"""
CANDIDATE = "run_key string, seq long, strategy string, path string, score double, psnr double, ssim double, gain_psnr double, gain_ssim double, mode string"


def number(x: Column) -> Column:
    """A double as JSON can hold it: what is no number, or without end, by name."""
    named = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(named.isNotNull(), named.cast("variant")).otherwise(x.cast("variant"))


def numbers(struct: Column, *names: str) -> Column:
    return F.struct(*[number(struct[n]).alias(n) for n in names])


def level(x: Column, steps: tuple, rest: str) -> Column:
    """The name of the first step that x reaches."""
    out = F.lit(rest)
    for least, name in reversed(steps):
        out = F.when(x >= least, name).otherwise(out)
    return out


def run_id(key: Column) -> Column:
    """Twelve hex digits that follow from the run's key, so that a report made again is the same."""
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 12)


def slim(c: Column) -> Column:
    """A candidate's eight columns; anything else that it carries stays out of the report."""
    return F.struct(*[(number(c[n]) if n in ("score", "psnr", "ssim", "gain_psnr", "gain_ssim") else c[n]).alias(n) for n in SLIM])


def analysis(iou: Column, improvement: Column, gain: Column, psnr_gain: Column, ssim_gain: Column, score: Column) -> Column:
    """Struct of labels and notes; what is null counts as 0, an unknown improvement as none. Gains in notes are rounded half up."""
    iou, gain, psnr_gain, ssim_gain, score = (F.coalesce(x, F.lit(0.0)) for x in (iou, gain, psnr_gain, ssim_gain, score))
    found, rank = level(iou, DETECTION, "poor"), level(score, LEVELS, "poor")
    effect = F.when(F.coalesce(improvement, F.lit(False)) & (gain > 0), "improved").when(F.abs(gain) < 0.5, "neutral").otherwise("degraded")
    notes = F.array_compact(F.array(
        F.when(found == "poor", "imprecise detection"), F.when(effect == "degraded", "no measurable gain"), F.when((found == "good") & (effect == "improved"), "located and improved"),
        F.when(psnr_gain > 3, F.format_string("PSNR gain +%.1f dB", psnr_gain)), F.when(ssim_gain > 0.05, F.format_string("SSIM gain +%.3f", ssim_gain)), F.when(rank == "excellent", "excellent score"),
    ))
    notes = F.when(F.size(notes) == 0, F.array(F.lit("nothing unusual"))).otherwise(notes)
    return F.struct(found.alias("detection_quality"), effect.alias("repair_effectiveness"), rank.alias("score_level"), number(score).alias("score"), number(iou).alias("iou"), number(psnr_gain).alias("psnr_gain"), number(ssim_gain).alias("ssim_gain"), notes.alias("notes"))


def reports(runs: DataFrame, candidates: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """(run_key, report): a nested report for each run (RUN), with its candidates (CANDIDATE), best first.

    Candidates go by score, ties by seq, those without a score last; a run without any has an empty list and a best candidate of
    nulls. `defaults` fill what a run's `extra` doesn't set: execution_mode, detection_mode, seed, recoverability_status,
    corruption_classification, detection_confidence, detected_mask_path, method, retry_count.
    """
    kept = candidates.where("run_key is not null").select("run_key", F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("order"), "seq", *SLIM).alias("c"))
    lists = kept.groupBy("run_key").agg(F.array_sort(F.collect_list("c")).alias("list"))
    none = "array<struct<order:double,seq:bigint," + ",".join(f"{n}:{'double' if n not in ('strategy', 'path', 'mode') else 'string'}" for n in SLIM) + ">>"
    rows = runs.join(lists, "run_key", "left").withColumn("list", F.coalesce("list", F.array().cast(none)))
    base = {"retry_count": "0"} | (defaults or {})
    given = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    filled = F.map_concat(F.map_filter(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), lambda k, _: ~F.map_contains_key(given, k)), given)
    rows = rows.withColumn("extra", filled).withColumn("best", F.get("list", 0))
    extra = lambda n: F.try_element_at("extra", F.lit(n)).alias(n)
    c, best = F.col("corruption"), F.col("best")
    parameters = F.coalesce(c["parameters"], F.create_map().cast("map<string,string>"))
    report = F.struct(
        run_id(F.col("run_key")).alias("run_id"), F.col("at").alias("timestamp"), F.coalesce("status", F.lit("completed")).alias("status"),
        F.struct("source_image", c["type"].alias("corruption_type"), extra("execution_mode"), extra("detection_mode"), extra("seed")).alias("input"),
        F.struct(c["type"].alias("type"), parameters.alias("parameters"), c["image_path"].alias("image_path"), c["mask_path"].alias("mask_path"), F.try_element_at("extra", F.lit("detected_mask_path")).alias("detected_mask"), F.coalesce(c["randomize"], F.lit(False)).alias("randomize"), F.coalesce(c["imperfect_mask"], F.lit(False)).alias("imperfect_mask")).alias("corruption"),
        F.struct(
            slim(best).alias("best_candidate"), F.transform("list", slim).alias("all_candidates"), best["strategy"].alias("selected_strategy"), F.col("recommended").alias("recommended_strategy"), number(best["score"]).alias("score"),
            F.try_element_at("extra", F.lit("retry_count")).cast("long").alias("retry_count"), extra("detection_confidence"), extra("method"), c["type"].alias("corruption_type_used"),
        ).alias("reconstruction"),
        F.struct(
            numbers(F.col("before"), "psnr", "ssim").alias("original_vs_corrupted"), numbers(F.col("after"), "psnr", "ssim").alias("original_vs_reconstructed"), numbers(F.col("gains"), "psnr_gain", "ssim_gain", "improvement_score").alias("gains"),
            F.coalesce("improvement", F.lit(False)).alias("improvement"), numbers(F.col("detection"), "iou", "precision", "recall").alias("detection_metrics"), extra("recoverability_status"),
        ).alias("metrics"),
        extra("corruption_classification"), extra("detection_confidence"),
        analysis(F.col("detection.iou"), F.col("improvement"), F.col("gains.improvement_score"), F.col("gains.psnr_gain"), F.col("gains.ssim_gain"), best["score"]).alias("analysis"),
    )
    return rows.select("run_key", report.alias("report"))


def custody(at: Column, *files: tuple[Column, Column]) -> Column:
    """Steps of the chain of custody for (path, sha256) of the original, damaged and repaired file; those without a path are left out."""
    note = lambda step: F.lit(NOTE) if step == STEPS[-1][0] else F.lit(None).cast("string")
    made = [F.when(path.isNotNull(), F.struct(F.lit(s).alias("step"), F.lit(label).alias("label"), path.alias("path"), sha.alias("sha256"), at.alias("timestamp"), F.lit(action).alias("action"), note(s).alias("note"))) for (s, label, action), (path, sha) in zip(STEPS, files, strict=True)]
    return F.array_compact(F.array(*made))


def legal(made: DataFrame, digests: DataFrame, at: Column) -> DataFrame:
    """(run_key, legal): each report (run_key, report) with what a legal one adds.

    digests: run_key, original, corrupted, reconstructed, the sha256 of those files; null and missing ones are empty.
    """
    rows = made.join(digests, "run_key", "left")
    r = F.col("report")
    best = r["reconstruction"]["best_candidate"]
    sha = {n: F.coalesce(n, F.lit("")) for n in ("original", "corrupted", "reconstructed")}
    chosen = F.lower(F.coalesce(r["reconstruction"]["selected_strategy"], best["strategy"], F.lit("")))
    generative = F.contains(chosen, F.lit(GENERATIVE))
    named = lambda s: F.lower(F.coalesce(s, F.lit("")))
    safe = lambda s: ~F.exists(F.array(*[F.lit(x) for x in NOT_FORENSIC]), lambda x: F.contains(named(s), x))
    methods = F.transform(r["reconstruction"]["all_candidates"], lambda c: F.struct(F.coalesce(c["strategy"], F.lit("—")).alias("strategy"), c["score"].alias("score"), c["psnr"].alias("psnr"), c["ssim"].alias("ssim"), F.coalesce(c["mode"], F.lit("blind")).alias("mode"), safe(c["strategy"]).alias("forensic_safe")))
    files = (r["input"]["source_image"], sha["original"]), (r["corruption"]["image_path"], sha["corrupted"]), (best["path"], sha["reconstructed"])
    fields = next(f.dataType for f in made.schema if f.name == "report").names
    out = F.struct(
        *[r[n].alias(n) for n in fields], F.lit(True).alias("legal_report"), at.alias("generated_at"), F.lit(LEGAL_VERSION).alias("report_version"), r["run_id"].alias("analysis_id"), custody(at, *files).alias("chain_of_custody"), methods.alias("table_of_methods"),
        F.when(generative, "generative").otherwise("forensic_safe").alias("forensic_mode"), sha["original"].alias("sha256_original"), sha["reconstructed"].alias("sha256_reconstructed"), F.lit(DISCLAIMER).alias("disclaimer"), F.lit(NOTE).alias("legal_note"),
        F.when(generative, WARNINGS[True]).otherwise(WARNINGS[False]).alias("warning"), F.struct(*[F.lit(v).alias(k) for k, v in CERTIFICATIONS.items()]).alias("certifications"),
    )
    return rows.select("run_key", out.alias("legal"))


def text(column: str) -> Column:
    """A nested column as JSON, nulls included, so that every report has all its keys."""
    return F.to_json(column, {"ignoreNullFields": "false"})
