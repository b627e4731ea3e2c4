"""Status of analyses as a table of versions: each batch of a stream makes one from the version before, replays included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions kept: the newest, which readers see, and the one that its batch would be made from again.
KEPT = 2
# The states of an analysis and where each may go.
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
LEGAL = {PENDING: (RUNNING, FAILED), RUNNING: (COMPLETED, FAILED), COMPLETED: (), FAILED: ()}

EVENTS = "analysis_id string, ts timestamp, seq long, kind string, status string, key string, value string, score double, elapsed_s double"
DONE = "struct<strategy:string,score:double,elapsed_s:double>"
STATE = f"struct<alive:boolean,status:string,created_at:timestamp,updated_at:timestamp,request:string,error:string,files:map<string,string>,progress:map<string,string>,events:array<{DONE}>,refused:bigint>"
ROW = "analysis_id string, status string, created_at timestamp, updated_at timestamp, request string, error string, files map<string,string>, progress map<string,string>, strategy_completed_events array<struct<strategy:string,score:double,elapsed_s:double>>, refused long"


def put(map_: Column, key: Column, value: Column) -> Column:
    """The map with key set to value, whether it was there or not."""
    return F.map_concat(F.map_filter(map_, lambda k, _: k != key), F.create_map(key, value))


def step(state: Column, e: Column) -> Column:
    """State after an event. Events of an analysis that isn't there, and illegal changes of its status, are refused.

    created starts it anew as pending; status changes it; progress and file set a key; strategy_completed adds to the list;
    error sets the message; deleted removes it.
    """
    field = lambda **changed: F.struct(*[changed.get(n, state[n]).alias(n) for n in ("alive", "status", "created_at", "updated_at", "request", "error", "files", "progress", "events", "refused")])
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    text = lambda: F.lit(None).cast("string")
    legal = F.lit(False)
    for was, to in LEGAL.items():
        legal = legal | ((state["status"] == was) & e["status"].isin(*to) if to else F.lit(False))
    new = field(alive=F.lit(True), status=F.lit(PENDING), created_at=e["ts"], updated_at=e["ts"], request=e["value"], error=text(), files=empty, progress=empty, events=F.array().cast(f"array<{DONE}>"), refused=F.lit(0).cast("long"))
    refused = field(refused=state["refused"] + 1)
    keyed = e["key"].isNotNull()
    return (
        F.when(e["kind"] == "created", new)
        .when(~state["alive"], refused)
        .when(e["kind"] == "deleted", field(alive=F.lit(False)))
        .when((e["kind"] == "status") & F.coalesce(legal, F.lit(False)), field(status=e["status"], updated_at=e["ts"]))
        .when((e["kind"] == "progress") & keyed, field(progress=put(state["progress"], e["key"], e["value"]), updated_at=e["ts"]))
        .when((e["kind"] == "file") & keyed, field(files=put(state["files"], e["key"], e["value"]), updated_at=e["ts"]))
        .when(e["kind"] == "strategy_completed", field(events=F.concat(state["events"], F.array(F.struct(e["key"].alias("strategy"), e["score"].alias("score"), e["elapsed_s"].alias("elapsed_s")).cast(DONE))), updated_at=e["ts"]))
        .when(e["kind"] == "error", field(error=e["value"], updated_at=e["ts"]))
        .otherwise(refused)
    )


def merged(before: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of the store after events (EVENTS, in order of ts and seq; repeated ones count once) on top of before (ROW)."""
    columns = [c.strip().split()[0] for c in EVENTS.split(", ")][1:]
    lists = events.where("analysis_id is not null").groupBy("analysis_id").agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("list"))
    names = ("status", "created_at", "updated_at", "request", "error", "files", "progress")
    rows = before.join(lists, "analysis_id", "full")
    start = F.struct(F.col("status").isNotNull().alias("alive"), *[F.col(n).alias(n) for n in names], F.col("strategy_completed_events").alias("events"), F.coalesce("refused", F.lit(0).cast("long")).alias("refused")).cast(STATE)
    state = F.when(F.col("list").isNull(), start).otherwise(F.aggregate("list", start, lambda s, e: step(s, e).cast(STATE)))
    rows = rows.select("analysis_id", state.alias("s")).where("s.alive")
    return rows.select("analysis_id", *[F.col(f"s.{n}") for n in names], F.col("s.events").alias("strategy_completed_events"), "s.refused")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of the store, the newest last; those that a lost driver left half-written don't count."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = [x.getPath() for x in store.listStatus(folder)]
    whole = [p.getName() for p in found if p.getName().startswith("batch=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def read(spark: SparkSession, path: str, schema: str = ROW, below: int | None = None) -> DataFrame:
    """The newest version, or the newest made by a batch before `below`; without one, no rows."""
    at = [v for v in versions(spark, path) if below is None or v < below]
    return spark.read.schema(schema).parquet(f"{path}/batch={at[-1]}") if at else spark.createDataFrame([], schema)


def upserts(path: str, schema: str = ROW, merge: Callable[[DataFrame, DataFrame], DataFrame] = merged) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: the version of a batch is made of the one before it and the batch, so a replay changes nothing.

    Older versions are dropped once theirs is whole.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merge(read(spark, path, schema, batch_id), batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for old in [v for v in versions(spark, path) if v <= batch_id][:-KEPT]:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"batch={old}"), True)

    return write


def replaced(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge for streams in update mode: a batch's rows stand for those of the same keys."""

    def merge(before: DataFrame, batch: DataFrame) -> DataFrame:
        return before.join(batch, keys, "left_anti").unionByName(batch)

    return merge
