"""Streams over files in several batches, replays and restarts, and the status store against a plain walk."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.operators import carve
from evidentia.sources import tables
from evidentia.streaming import heartbeat, progress, store

START = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)
BEATING = "task long, ts timestamp, seq long, family string"


def at(seconds):
    return (START + dt.timedelta(seconds=seconds)).replace(tzinfo=None)


def beats_by_hand(rows, until, every=10):
    out = set()
    by_task = {}
    for task, ts, seq, family in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_task.setdefault(task, []).append((ts, family))
    for task, events in by_task.items():
        for i, (ts, family) in enumerate(events):
            k = 1
            while family in heartbeat.LONG_FAMILIES and (ts + k * every < events[i + 1][0] if i + 1 < len(events) else ts + k * every <= until):
                out.add((task, family, at(ts), k, float(k * every)))
                k += 1
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_beats_do_not_depend_on_the_batches(spark, tmp_path, files):
    rng = random.Random(7)
    rows = [(rng.randrange(5), s, s, rng.choice(["criminisi", "patchmatch", "denoise", None])) for s in sorted(rng.sample(range(3000), 120))]
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame([(t, at(s), q, f) for t, s, q, f in part], BEATING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(BEATING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = progress.drained(heartbeat.beating(events, "100 seconds"), "append", folder=str(tmp_path / "out"))
    last = max(r[1] for r in rows)
    want = beats_by_hand(rows, last - 100)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    table = spark.createDataFrame([(t, at(s), q, f, at(last - 100)) for t, s, q, f in rows], BEATING + ", until timestamp")
    assert {tuple(r) for r in heartbeat.beats(table, "until").collect()} == want


def test_state_is_read_and_written_once_a_task_and_batch():
    asked = []

    class Held:
        value = None

        def get(self):
            asked.append("get")
            return self.value

        def exists(self):
            asked.append("exists")
            return self.value is not None

        def update(self, value):
            asked.append("update")
            self.value = value

        def clear(self):
            asked.append("clear")
            self.value = None

    class Handle:
        listTimers = staticmethod(lambda: asked.append("list") or [])  # noqa: N815
        registerTimer = deleteTimer = staticmethod(lambda at: asked.append("timer"))  # noqa: N815

    rows = [(s, s, ["criminisi", "denoise", "patchmatch"][s % 3]) for s in range(0, 9000, 31)]
    heart = heartbeat.Heart(10)
    heart.handle, heart.open = Handle(), Held()
    frames = list(heart.handleInputRows((4,), iter([pd.DataFrame([(at(s), q, f) for s, q, f in rows], columns=["ts", "seq", "family"])]), None))
    assert len(asked) < 8
    got = {(t, f, b.to_pydatetime(), k, e) for frame in frames for t, f, b, k, e in frame.itertuples(index=False)}
    assert got == beats_by_hand([(4, *r) for r in rows], max(r[0] for r in rows))


def walk(events):
    """The store after events, one after the other."""
    found, legal = {}, {("pending", "running"), ("pending", "failed"), ("running", "completed"), ("running", "failed")}
    refused = {}
    for a, ts, _, kind, status, key, value, score, elapsed in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if kind == "created":
            found[a], refused[a] = {"status": "pending", "created": ts, "updated": ts, "request": value, "error": None, "files": {}, "progress": {}, "events": []}, 0
            continue
        row = found.get(a)
        ok = row is not None
        if ok and kind == "deleted":
            found.pop(a)
            continue
        if ok and kind == "status" and (row["status"], status) in legal:
            row["status"] = status
        elif ok and kind == "progress" and key is not None:
            row["progress"][key] = value
        elif ok and kind == "file" and key is not None:
            row["files"][key] = value
        elif ok and kind == "strategy_completed":
            row["events"].append((key, score, elapsed))
        elif ok and kind == "error":
            row["error"] = value
        else:
            refused[a] = refused.get(a, 0) + 1
            continue
        row["updated"] = ts
    return {a: (r, refused[a]) for a, r in found.items()}


def stored(df):
    rows = df.collect()
    assert len({r["analysis_id"] for r in rows}) == len(rows)
    return {
        r["analysis_id"]: ({"status": r["status"], "created": r["created_at"], "updated": r["updated_at"], "request": r["request"], "error": r["error"], "files": r["files"], "progress": r["progress"], "events": [tuple(e) for e in r["strategy_completed_events"]]}, r["refused"])
        for r in rows
    }


def some_events(n, seed=3):
    rng = random.Random(seed)
    kinds = ["created", "status", "status", "status", "progress", "file", "strategy_completed", "strategy_completed", "error", "deleted", "what"]
    return [(f"a{rng.randrange(12)}", at(i), i, rng.choice(kinds), rng.choice(["running", "completed", "failed", "pending", None]), rng.choice(["k1", "k2", None]), f"v{i}", rng.random(), float(i)) for i in range(n)]


def test_store_in_batches_with_replays(spark, tmp_path):
    path, events = str(tmp_path / "store"), some_events(240)
    write = store.upserts(path)
    parts = [spark.createDataFrame(events[i : i + 60], store.EVENTS).repartition(3) for i in range(0, 240, 60)]
    write(parts[0], 0)
    write(parts[1], 1)
    once = stored(store.read(spark, path))
    write(parts[1], 1)
    assert stored(store.read(spark, path)) == once == walk(events[:120])
    write(parts[2].union(parts[2]), 2)
    write(parts[3], 3)
    assert stored(store.read(spark, path)) == walk(events)
    assert store.versions(spark, path) == [2, 3]
    write(spark.createDataFrame([], store.EVENTS), 4)
    assert stored(store.read(spark, path)) == walk(events)
    assert store.read(spark, str(tmp_path / "none")).count() == 0


def test_half_written_versions_do_not_count(spark, tmp_path):
    path, events = str(tmp_path / "store"), some_events(50)
    store.upserts(path)(spark.createDataFrame(events, store.EVENTS), 0)
    (tmp_path / "store" / "batch=1").mkdir()
    (tmp_path / "store" / "batch=1" / "part-0.parquet").write_bytes(b"torn")
    assert stored(store.read(spark, path)) == walk(events)


@pytest.mark.parametrize("mode", ["complete", "update", "append"])
def test_a_drained_folder_goes_on_where_it_stopped(spark, tmp_path, mode):
    schema = "user_id long, ts timestamp, event_id long, event_type string, value double"
    row = lambda i: (i % 4, at(i * 900), i, ["view", "error"][i % 2], float(i))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    make = {"complete": progress.counts, "update": progress.hourly, "append": progress.throttled}[mode]
    for since, upto in ((0, 40), (40, 100)):
        spark.createDataFrame([row(i) for i in range(since, upto)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = progress.drained(make(stream), mode, ("hour_start", "event_type"), str(tmp_path / "out"))
        table = spark.createDataFrame([row(i) for i in range(upto)], schema)
        if mode == "append":
            assert got.count() == upto  # a quarter of an hour apart: all are logged
        else:
            assert {tuple(r) for r in got.collect()} == {tuple(r) for r in make(table).collect()}


def test_table_function_equals_the_ranged_scan(spark, tmp_path):
    rng = random.Random(1)
    for k in range(3):
        (tmp_path / f"d{k}.bin").write_bytes(bytes(rng.choices(b"ab\xff\xd8", k=4000)))
    (tmp_path / "empty.bin").write_bytes(b"")
    dumps = tables.dumps(spark, str(tmp_path))
    for marker in (b"\xff\xd8", b"aa"):
        want = sorted(tuple(r) for r in tables.marker_offsets(spark, str(tmp_path), marker, size=512).collect())
        assert sorted(tuple(r) for r in carve.places(dumps, marker).collect()) == want
    assert carve.places(dumps.withColumn("content", F.lit(None).cast("binary")), b"a").count() == 0
