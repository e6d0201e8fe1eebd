"""The watch cycle: change events are gathered until they pause, worked on in one cycle at a time, and put back if it fails.

Events (root, path, event, at) come as a file stream. A stateful operator holds
what waits for each root: the last event of each path, and one processing-time
timer that every new event sets anew (debounce). When it fires, all that waits is
passed on. Each micro-batch with such rows is one cycle, whose results are one
commit of versioned tables under the number of the batch: a batch that Spark
replays finds its number there and changes nothing.

A cycle that fails is logged, and its events go to the folder ``retry``, which the
stream reads too; they come back with one failure more. From the third failure on
a row the pause doubles with each, up to thirty seconds.

What a cycle does (``refresh``): changes of code files go to the table ``sources``
at once, unless they would drop too large a share of it; all other changes wait in
``pending``, last event of a path first, and pages of their sources are stale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftgraph.operators.graph import first_wins
from weftgraph.operators.versions import Tables, files
from weftgraph.streaming.refresh import is_code, latest_pending, stale_pages

EVENTS = "root string, path string, event string, at timestamp, failures int"
RUNS = "batch long, started timestamp, reasons long, code long, deferred long, removed long, ok boolean, error string"
SOURCES, PENDING = "path string, source_id string, at timestamp", "path string, at timestamp, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEBOUNCE_MS, BACKOFF_FROM, MOST_MS, SHRINK = 900, 3, 30_000, 0.25


class ShrinkBlocked(ValueError):
    """A cycle would drop too large a share of the sources."""


def pause_ms(failures: int, debounce: int = DEBOUNCE_MS) -> int:
    """How long events of so many failures wait."""
    return debounce if failures < BACKOFF_FROM else min(debounce * 2 ** min(30, failures - BACKOFF_FROM), MOST_MS)


class Debounce(StatefulProcessor):
    """Holds the last event of each path of a root until no event has come for a while."""

    def __init__(self, debounce: int = DEBOUNCE_MS):
        self.debounce = debounce

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "path string", "event string, at timestamp, failures int")
        self.due = handle.getValueState("due", "ms long, failures int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self.due.get()
        failures = due[1] if due else 0
        for part in rows:
            for row in part.sort_values("at", kind="stable").itertuples():
                again = 0 if pd.isna(row.failures) else int(row.failures)
                held = self.waiting.getValue((row.path,)) if self.waiting.containsKey((row.path,)) else None
                if held is None or pd.Timestamp(held[1]) <= row.at:
                    self.waiting.updateValue((row.path,), (row.event, row.at.to_pydatetime(), again))
                failures = max(failures, again)
        if due:
            self.handle.deleteTimer(due[0])
        at = timerValues.getCurrentProcessingTimeInMs() + pause_ms(failures, self.debounce)
        self.handle.registerTimer(at)
        self.due.update((at, failures))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = [(key[0], path[0], *event) for path, event in self.waiting.iterator()]
        self.waiting.clear()
        self.due.clear()
        yield pd.DataFrame(rows, columns=["root", "path", "event", "at", "failures"])

    def close(self) -> None:
        pass


def refresh(tables: Tables, changes: DataFrame, most_shrink: float | None = SHRINK) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(tables to commit, counts) of changes (root, path, event, at): see the module. ``most_shrink`` None lets sources go whatever their share."""
    sources, pending = tables.read("sources", SOURCES), tables.read("pending", PENDING)
    last = first_wins(changes, ["root", "path"], [F.desc("at"), F.col("event")]).withColumn("code", is_code())
    name = F.concat_ws("/", "root", "path")
    code = last.where("code").select(name.alias("path"), "event", "at")
    gone = code.where("event in ('unlink', 'unlinkDir')").select("path")
    put = code.where("event not in ('unlink', 'unlinkDir')").select("path", F.sha2("path", 256).substr(1, 16).alias("source_id"), "at")
    removed, n = sources.join(gone, "path", "left_semi").count(), sources.count()
    if most_shrink is not None and n and removed / n > most_shrink:
        raise ShrinkBlocked(f"{removed} of {n} sources would go")
    now = sources.join(gone, "path", "left_anti").join(put.select("path"), "path", "left_anti").unionByName(put)
    deferred = last.where("not code").select(name.alias("path"), "at", F.col("event").alias("reason"))
    waiting = latest_pending(pending, deferred)
    changed = {"sources": now, "pending": waiting}
    pages = tables.read("pages")
    if pages is not None:
        changed["pages"] = stale_pages(pages, waiting.join(sources.select("path", "source_id"), "path").select("source_id").distinct())
    return changed, {"code": code.count(), "deferred": deferred.count(), "removed": removed}


def run_batch(tables: Tables, batch: DataFrame, number: int, writer: str = "watch", cycle: Callable[[Tables, DataFrame], tuple[dict[str, DataFrame], dict[str, int]]] = refresh, retry: str | None = None) -> bool | None:
    """One cycle over the rows of a micro-batch: True if it was committed, False if it failed and its events were put back, None if there was nothing to do or the batch was done before."""
    token = (writer, number)
    if tables.done(token):
        return None
    held = batch.persist()
    try:
        reasons = held.count()
        if not reasons:
            return None
        spark = batch.sparkSession
        runs, started = tables.read("runs", RUNS), spark.sql("SELECT now()").first()[0]
        log = lambda ok, counts, error: runs.unionByName(spark.createDataFrame([(number, started, reasons, counts.get("code"), counts.get("deferred"), counts.get("removed"), ok, error)], RUNS))
        try:
            changed, counts = cycle(tables, held.drop("failures"))
            return tables.commit_tables(changed | {"runs": log(True, counts, None)}, token) or None
        except Exception as problem:  # whatever stopped the cycle, its events must not be lost
            held.withColumn("failures", F.coalesce("failures", F.lit(0)) + 1).select("root", "path", "event", "at", "failures").write.mode("overwrite").parquet(f"{retry or tables.root + '/retry'}/batch={number}-{writer}")
            tables.commit_tables({"runs": log(False, {}, f"{type(problem).__name__}: {problem}"[:500])}, token)
            return False
    finally:
        held.unpersist()


def watch(spark: SparkSession, events: str, state: str, checkpoint: str, debounce: int = DEBOUNCE_MS, every: str = "1 second", cycle=refresh, writer: str = "watch"):
    """Starts the stream over the folder ``events``; tables and retries are under ``state``. Stop it with ``stop()``: it goes on where it was."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    tables, retry = Tables(spark, state), f"{state.rstrip('/')}/retry"
    for folder in (events, retry):
        store, path = files(spark, folder)
        store.mkdirs(path)
    read = lambda folder: spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(folder)
    waiting = read(events).unionByName(read(retry)).groupBy("root").transformWithStateInPandas(Debounce(debounce), EVENTS, "Append", "ProcessingTime")
    return (
        waiting.writeStream.foreachBatch(lambda batch, number: run_batch(tables, batch, number, writer, cycle, retry) and None)
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )

