"""Structured Streaming: change events to a pending table, refresh cycles, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.operators.graph import first_wins

CODE = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "kt", "c", "h", "cpp", "cs", "rb", "php", "scala", "swift", "sql", "sh")


def latest_pending(old: DataFrame | None, events: DataFrame) -> DataFrame:
    """Pending changes (path, at, reason): the last event of each path wins over older ones and over what was pending."""
    whole = events.select("path", "at", "reason") if old is None else old.select("path", "at", "reason").unionByName(events.select("path", "at", "reason"))
    return first_wins(whole, "path", [F.desc("at"), F.col("reason")])


def is_code(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*CODE)


def watch(spark: SparkSession, source: str, schema: str, cycle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """A file stream of change events; each micro-batch is one refresh cycle. Code changes are worked on at once, others go to the cycle as pending."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, n: cycle(batch.withColumn("is_code", is_code()), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="1 second").start()


def stale_pages(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """pages with freshness stale where a source of theirs (source_ids) is in changed(source_id)."""
    hit = pages.select("id", F.explode("source_ids").alias("source_id")).join(changed.select("source_id"), "source_id", "left_semi").select("id").distinct().withColumn("_hit", F.lit(True))
    return pages.join(hit, "id", "left").withColumn("freshness", F.when(F.col("_hit"), "stale").otherwise(F.col("freshness"))).drop("_hit")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions by gap; batch or stream."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def growing_groups(events: DataFrame, key: str = "user_id", window_hours: float = 24.0) -> DataFrame:
    """Streaming groups (key, group_no, n): an event joins its key's open group if it is recent enough, else begins the next."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, latest, n = state.get if state.exists else (-1, 0, 0)
        changed: dict[int, int] = {}
        rows = pd.concat(list(batches)).sort_values("ts")
        for at in rows["ts"]:
            ms = int(at.timestamp() * 1000)
            if number < 0 or ms - latest > window_hours * 3.6e6:
                number, n = number + 1, 0
            latest, n = max(latest, ms), n + 1
            changed[number] = n
        state.update((number, latest, n))
        yield pd.DataFrame({key: [k[0]] * len(changed), "group_no": list(changed), "n": list(changed.values())})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, group_no long, n long", "number long, latest long, n long", "update", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, width: str = "1 day", by: str = "event_type", at: str = "ts", late: str = "1 hour") -> DataFrame:
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
