"""Versioned tables and the watch cycle: whole commits, debounce, retries, replays."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.versions import Conflict, Tables
from weftgraph.streaming import watch as W

T0 = dt.datetime(2024, 5, 1)


def events(spark, rows):
    return spark.createDataFrame([(r, p, e, T0 + dt.timedelta(seconds=s), 0) for r, p, e, s in rows], W.EVENTS)


def rows(tables, name):
    df = tables.read(name)
    return [] if df is None else sorted(tuple(r) for r in df.collect())


def test_commits_are_whole(spark, tmp_path, monkeypatch):
    tables = Tables(spark, f"file://{tmp_path}/t")
    assert tables.read("a") is None and tables.read("a", "id int").count() == 0
    one, two = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(2, "y")], "id int, v string")
    assert tables.commit_tables({"a": one, "b": two}, ("w", 3)) and not tables.commit_tables({"a": two}, ("w", 3)) and not tables.commit_tables({"a": two}, ("w", 2))
    assert rows(tables, "a") == [(1, "x")] and rows(tables, "b") == [(2, "y")]
    version = tables.last()[0]
    with pytest.raises(Conflict):
        tables.commit(version - 1, {})
    monkeypatch.setattr(tables, "commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        tables.commit_tables({"a": two, "b": one})
    monkeypatch.undo()
    assert rows(tables, "a") == [(1, "x")] and rows(tables, "b") == [(2, "y")] and tables.last()[0] == version


def test_upsert(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    frame = lambda *r: spark.createDataFrame(list(r), "id int, v string")
    assert tables.upsert("p", "id", frame((1, "a"), (2, None))) == {"added": 2, "changed": 0, "removed": 0}
    version = tables.last()[0]
    assert tables.upsert("p", "id", frame((1, "a"))) == {"added": 0, "changed": 0, "removed": 0} and tables.last()[0] == version
    assert tables.upsert("p", "id", frame((1, "b"), (3, "c")), frame((2, "")).select("id")) == {"added": 1, "changed": 1, "removed": 1}
    assert rows(tables, "p") == [(1, "b"), (3, "c")]
    assert tables.change("p", lambda df: df.withColumn("v", F.upper("v"))) and not tables.change("p", lambda df: df.withColumn("v", F.upper("v")))
    assert rows(tables, "p") == [(1, "B"), (3, "C")]


def test_a_cycle_splits_guards_and_marks(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    first = events(spark, [("r", f"m{k}.py", "add", k) for k in range(8)] + [("r", "notes.md", "add", 1), ("r", "notes.md", "change", 2)])
    assert W.run_batch(tables, first, 0) is True
    assert [r[0] for r in rows(tables, "sources")] == [f"r/m{k}.py" for k in range(8)]
    assert [(r[0], r[2]) for r in rows(tables, "pending")] == [("r/notes.md", "change")]
    source = rows(tables, "sources")[0][1]
    tables.commit_tables({"pages": spark.createDataFrame([("p", [source], "fresh"), ("q", ["other"], "fresh")], "id string, source_ids array<string>, freshness string"), "pending": spark.createDataFrame([("r/m0.py", T0, "change")], W.PENDING)})
    # Pages of pending sources are stale; two of eight sources may go.
    assert W.run_batch(tables, events(spark, [("r", "m7.py", "unlink", 50), ("r", "m6.py", "unlink", 50), ("r", "m1.py", "change", 60)]), 1) is True
    assert len(rows(tables, "sources")) == 6 and [(r[0], r[2]) for r in rows(tables, "pages")] == [("p", "stale"), ("q", "fresh")]
    # A replayed batch changes nothing, an empty one neither.
    before = tables.last()
    assert W.run_batch(tables, first, 0) is None and W.run_batch(tables, first.limit(0), 2) is None and tables.last() == before
    # Too many gone at once: nothing is dropped, the events are put back with one failure more.
    assert W.run_batch(tables, events(spark, [("r", f"m{k}.py", "unlink", 70) for k in range(4)]), 3) is False
    assert len(rows(tables, "sources")) == 6
    back = spark.read.schema(W.EVENTS).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/t/retry").collect()
    assert len(back) == 4 and {r["failures"] for r in back} == {1}
    log = tables.read("runs").orderBy("batch").collect()
    assert [(r["batch"], r["ok"]) for r in log] == [(0, True), (1, True), (3, False)] and "ShrinkBlocked" in log[-1]["error"]
    # Without the guard they go.
    assert W.run_batch(tables, events(spark, [("r", f"m{k}.py", "unlink", 70) for k in range(4)]), 4, cycle=lambda t, c: W.refresh(t, c, None)) is True
    assert len(rows(tables, "sources")) == 2


def test_pauses():
    assert [W.pause_ms(n, 900) for n in (0, 2, 3, 4, 5, 9, 500)] == [900, 900, 900, 1_800, 3_600, 30_000, 30_000]


def until(test, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if test():
            return True
        time.sleep(0.3)
    return False


def test_stream_debounces_and_retries(spark, tmp_path):
    """Bursts of events make one cycle; a cycle that fails twice is tried again until it works; after a restart nothing is done twice."""
    inbox, state, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "state", "cp"))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    failed = []

    def cycle(tables, changes):
        if len(failed) < 2:
            failed.append(changes.count())
            raise OSError("not now")
        return W.refresh(tables, changes)

    tables = Tables(spark, state)
    try:
        events(spark, [("r", "a.py", "add", 1), ("r", "b.md", "add", 1)]).coalesce(1).write.mode("append").parquet(inbox)
        stream = W.watch(spark, inbox, state, checkpoint, debounce=700, every="200 milliseconds", cycle=cycle)
        events(spark, [("r", "c.py", "add", 2), ("r", "a.py", "change", 3)]).coalesce(1).write.mode("append").parquet(inbox)
        assert until(lambda: stream.exception() or any(r["ok"] for r in tables.read("runs", W.RUNS).collect())), stream.exception()
        log = tables.read("runs").orderBy("batch").collect()
        assert [r["ok"] for r in log] == [False, False, True] and all("not now" in r["error"] for r in log[:2])
        assert [r[0] for r in rows(tables, "sources")] == ["r/a.py", "r/c.py"] and [r[0] for r in rows(tables, "pending")] == ["r/b.md"]
        stream.stop()
        stream = W.watch(spark, inbox, state, checkpoint, debounce=300, every="200 milliseconds")
        events(spark, [("r", "d.py", "add", 9)]).coalesce(1).write.mode("append").parquet(inbox)
        assert until(lambda: stream.exception() or len(rows(tables, "sources")) == 3), stream.exception()
        assert len(tables.read("runs").collect()) == 4
        stream.stop()
    finally:
        for s in spark.streams.active:
            s.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
