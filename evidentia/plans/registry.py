"""Every query of the engine by name, with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fragments, repair
from ..sources.tables import raster, table
from ..streaming import progress
from . import apart, evidence, forensics
from .book import PLANS, for_duckdb, on_spark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: on_spark(sql) for name, sql in PLANS.items()}
ORACLES: dict[str, str] = {name: for_duckdb(sql) for name, sql in PLANS.items()}

#: Rules and scores whose checks are written apart; they stand for the plans of the same name.
QUERIES |= forensics.QUERIES | evidence.QUERIES
ORACLES |= apart.ORACLES | forensics.ORACLES | evidence.ORACLES


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures dealt out evenly: the kernels behind cost far more than moving them."""
    return repair.pack(raster(table(spark, sf_dir, "embeddings"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")


def damage_kernel_all(spark, sf_dir):
    return repair.corrupt(pictures(spark, sf_dir)).select("image_id", "kind", "touched", F.sha2("data", 256).alias("sha256"))


def repair_kernel_best(spark, sf_dir):
    return repair.best(repair.repair(repair.corrupt(pictures(spark, sf_dir), ["rectangle_mask"]))).drop("data")


def repair_kernel_blind(spark, sf_dir):
    return repair.best(repair.repair(repair.corrupt(pictures(spark, sf_dir), ["scratch_lines"]), supervised=False)).select("image_id", "kind", "strategy", "score")


def repair_kernel_plan(spark, sf_dir):
    """Which strategies ran on each picture, in order, and which failed."""
    rows = repair.repair(repair.corrupt(pictures(spark, sf_dir), ["rectangle_mask"]), recommended="inpainting")
    return rows.where("family <> 'iterative'").groupBy("image_id", "kind").agg(F.count("score").alias("done"), F.count("error").alias("failed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "strategy"))), lambda x: x["strategy"]), ",").alias("plan"))


def meta_regional(spark, sf_dir):
    """Regions of each damaged picture with the strategy that each got; their areas make up the mask."""
    return repair.regional_repair(repair.corrupt(pictures(spark, sf_dir), ["rectangle_mask"]))


def perceptual_hashes(spark, sf_dir):
    return repair.hashes(pictures(spark, sf_dir))


def mask_regions(spark, sf_dir):
    return repair.regions(repair.corrupt(pictures(spark, sf_dir), ["block_dropout"]))


def detect_components(spark, sf_dir):
    return repair.detections(pictures(spark, sf_dir))


def fragment_greedy_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("dump_id"), F.encode("text", "UTF-8").alias("b"))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / 6).cast("int"))
    cut = docs.select("dump_id", "b", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("idx"))
    cut = cut.select("dump_id", F.col("idx").cast("long"), (F.col("idx") * F.col("size")).cast("long").alias("off"), F.substring("b", F.col("idx") * F.col("size") + 1, F.col("size")).alias("data"))
    return fragments.greedy_chain(cut.where("octet_length(data) > 0")).withColumn("continuity", F.round("continuity", 6))


def dbscan_labels(spark, sf_dir):
    """Density clusters of the vectors as they are; 0.62 is where the first of them have neighbours."""
    return fragments.clusters(table(spark, sf_dir, "embeddings"), 0.62)


def stream_progress_counts(spark, sf_dir):
    return progress.drained(progress.counts(progress.event_stream(spark, sf_dir)), "complete")


def stream_hourly(spark, sf_dir):
    return progress.drained(progress.hourly(progress.event_stream(spark, sf_dir)), "update", ("hour_start", "event_type"))


def stream_throttle(spark, sf_dir):
    return progress.drained(progress.throttled(progress.event_stream(spark, sf_dir)), "append")


QUERIES |= {f.__name__: f for f in (repair_kernel_plan, meta_regional, damage_kernel_all, repair_kernel_best, repair_kernel_blind, perceptual_hashes, mask_regions, detect_components, fragment_greedy_chain, dbscan_labels, stream_progress_counts, stream_hourly, stream_throttle)}
ORACLES["stream_progress_counts"] = "SELECT user_id, count(*) AS completed, max(value) AS best, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id"
ORACLES["stream_hourly"] = "SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
ORACLES["stream_throttle"] = """WITH RECURSIVE n AS MATERIALIZED (SELECT user_id, event_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, event_type, k, true AS kept, t AS last FROM n WHERE k = 1
UNION ALL SELECT n.user_id, n.event_id, n.event_type, n.k, n.event_type IN ('error', 'purchase') OR n.t - w.last >= 30, CASE WHEN n.event_type IN ('error', 'purchase') OR n.t - w.last >= 30 THEN n.t ELSE w.last END FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1)
SELECT user_id, event_id, event_type FROM w WHERE kept"""
ORACLES["dbscan_labels"] = f"""WITH RECURSIVE ne AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {apart.COSINE} <= 0.62), rc AS (SELECT a AS id, a AS name FROM ne UNION SELECT ne.b, rc.name FROM rc JOIN ne ON ne.a = rc.id),
nm AS (SELECT id, min(name) AS name FROM rc GROUP BY id) SELECT vec_id, coalesce(name, -1) AS cluster FROM embeddings LEFT JOIN nm ON nm.id = vec_id"""
ORACLES["fragment_greedy_chain"] = """WITH RECURSIVE d AS (SELECT doc_id AS dump_id, hex(encode(text)) AS h, greatest(1, CAST(ceil(strlen(text) / 6) AS BIGINT)) AS n FROM documents WHERE text IS NOT NULL),
f AS MATERIALIZED (SELECT dump_id, idx, data, length(data) // 2 AS size, right(data, 128) AS tail, left(data, 128) AS head FROM (SELECT dump_id, idx, substr(h, CAST(2 * idx * n + 1 AS BIGINT), CAST(2 * n AS BIGINT)) AS data FROM d, range(6) i(idx)) q WHERE data <> ''),
w AS MATERIALIZED (SELECT *, list_transform(range(64), lambda k: CAST('0x' || substr(tail, 2 * k + 1, 2) AS INTEGER)) AS tb, list_transform(range(64), lambda k: CAST('0x' || substr(head, 2 * k + 1, 2) AS INTEGER)) AS hb, list_distinct(list_transform(range(33), lambda k: substr(tail, 2 * k + 1, 64))) AS tw, list_distinct(list_transform(range(33), lambda k: substr(head, 2 * k + 1, 64))) AS hw FROM f WHERE size >= 64),
o AS MATERIALIZED (SELECT a.dump_id, a.idx AS i, b.idx AS j, 0.65e0 * greatest(0e0, 1 - list_sum(list_transform(list_zip(a.tb, b.hb), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64e0 / 65025e0) + 0.35e0 * len(list_intersect(a.tw, b.hw)) / greatest(len(a.tw), len(b.hw)) AS overlap FROM w a JOIN w b ON a.dump_id = b.dump_id AND a.idx <> b.idx),
c AS MATERIALIZED (SELECT a.dump_id, a.idx AS i, b.idx AS j, 0.7e0 * coalesce(overlap, 0) + 0.3e0 * least(a.size, b.size) / greatest(a.size, b.size) AS score FROM f a JOIN f b ON a.dump_id = b.dump_id AND a.idx <> b.idx LEFT JOIN o ON o.dump_id = a.dump_id AND o.i = a.idx AND o.j = b.idx),
g AS (SELECT dump_id, CAST(0 AS BIGINT) AS place, min(idx) AS idx, CAST(NULL AS DOUBLE) AS continuity, [min(idx)] AS used FROM f GROUP BY dump_id
UNION ALL SELECT dump_id, place + 1, j, score, list_append(used, j) FROM (SELECT g.dump_id, g.place, c.j, c.score, g.used, row_number() OVER (PARTITION BY g.dump_id ORDER BY c.score DESC, c.j) AS k FROM g JOIN c ON c.dump_id = g.dump_id AND c.i = g.idx AND NOT list_contains(g.used, c.j)) q WHERE k = 1)
SELECT dump_id, place, idx, round(continuity, 6) AS continuity FROM g"""
