"""Lifecycle: decay, supersession, tiers, promotion, lint."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scoring import STALE_BELOW, decay, jaccard
from weftgraph.functions.text import workflow_verb

PROMOTION = {"sources": 3, "confidence": 0.8, "agreement": 0.7, "degree": 2, "age": 24.0}


def apply_decay(pages: DataFrame, now: Column, below: float = STALE_BELOW) -> DataFrame:
    """pages(id, source_class, confirmed_at, superseded_by, freshness) with decay_score, freshness and newly_stale."""
    score = decay(F.col("confirmed_at"), now, F.col("source_class"))
    fresh = F.when(F.col("superseded_by").isNotNull() | (score < below), "stale").otherwise("fresh")
    return pages.withColumn("decay_score", score).withColumn("newly_stale", (fresh == "stale") & ~F.col("freshness").eqNullSafe("stale")).withColumn("freshness", fresh)


def supersede(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """pages with (old, new) pairs applied: the old page points to the new one, is stale and has score 0."""
    by = pairs.groupBy(F.col("old").alias("id")).agg(F.max("new").alias("_new"))
    hit = F.col("_new").isNotNull()
    return pages.join(by, "id", "left").withColumns({"superseded_by": F.coalesce("_new", "superseded_by"), "freshness": F.when(hit, "stale").otherwise(F.col("freshness")), "decay_score": F.when(hit, 0.0).otherwise(F.col("decay_score"))}).drop("_new")


def group_sessions(pages: DataFrame, key: str, window_hours: float = 24.0, ratio: float = 0.3) -> DataFrame:
    """(key, id, group_no): pages(key, id, at, marks array) of one key, in order of time, join the first group that is recent enough and shares enough marks; a group's marks grow.

    Rows are cut at gaps longer than the window (stretch): no group spans one. A
    key's rows pass in order of time through one task, which keeps only the groups
    that are still recent enough: what it holds and does for a row does not grow
    with the rows of a key or with the number of keys.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    window = window_hours * 3.6e9

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, latest, stretch, count, recent = False, None, 0, 0, 0, []
        for batch in batches:
            stretches, numbers = [], []
            for own_key, at, marks in zip(*(batch.column(c).to_pylist() for c in ("_key", "at", "marks")), strict=True):
                if not begun or own_key != now:
                    begun, now, stretch, count, recent = True, own_key, 0, 0, []
                elif at - latest > window:
                    stretch, count, recent = stretch + 1, 0, []
                latest, own = at, set(marks or ())
                recent = [g for g in recent if at - g[1] <= window]
                for g in recent:
                    both = len(own & g[2])
                    union = len(own) + len(g[2]) - both
                    if union and both / union >= ratio:
                        g[1] = at
                        g[2] |= own
                        number = g[0]
                        break
                else:
                    number = count
                    recent.append([number, at, own])
                    count += 1
                stretches.append(stretch)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(stretches, pa.int64()), pa.array(numbers, pa.int64())], [key, "id", "stretch", "group_no"])

    rows = pages.where("at is not null").select(F.col(key).alias("key"), F.col(key).cast("string").alias("_key"), "id", F.unix_micros("at").alias("at"), "marks")
    dealt = rows.repartition("key").sortWithinPartitions("key", "at", "id")
    return dealt.mapInArrow(fold, f"`{key}` {kinds[key]}, id {kinds['id']}, stretch long, group_no long")


def episodes(grouped: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Groups of enough pages with their confidence."""
    return grouped.groupBy(key, "stretch", "group_no").agg(F.count("*").alias("pages"), F.sort_array(F.collect_list("id")).alias("ids")).where(F.col("pages") >= least).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.4 + 0.1 * F.col("pages")), 6))


def recurring_nodes(episodic: DataFrame, now: Column, least: int = 3, days: int = 90) -> DataFrame:
    """(node_id, episodes, confidence): nodes that enough recent pages (id, updated_at, node_ids) have."""
    recent = episodic.where(F.col("updated_at") >= now - F.expr(f"interval {days} days")).select("id", F.explode(F.array_distinct("node_ids")).alias("node_id"))
    return recent.groupBy("node_id").agg(F.count_distinct("id").alias("episodes")).where(F.col("episodes") >= least).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.col("episodes")), 6))


def workflows(semantic: DataFrame, least: int = 3) -> DataFrame:
    """(verb, pages, confidence) of pages (id, title) whose titles name a workflow."""
    named = semantic.select("id", workflow_verb(F.col("title")).alias("verb")).where("verb is not null")
    return named.groupBy("verb").agg(F.count_distinct("id").alias("pages")).where(F.col("pages") >= least).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.6 + 0.1 * F.col("pages")), 6))


def promotion(candidates: DataFrame, gates: dict[str, float] | None = None, limit: int | None = 25) -> DataFrame:
    """(id, passed, score, promote) of candidates (id, source_ids, previous_ids, confidence, degree, age_hours); the ones to promote first."""
    g = {**PROMOTION, **(gates or {})}
    agreement = F.when(F.size(F.coalesce("previous_ids", F.array().cast("array<string>"))) <= 0, 0.0).otherwise(jaccard(F.col("previous_ids"), F.col("source_ids"), 1.0))
    tests = [F.size("source_ids") >= g["sources"], F.col("confidence") >= g["confidence"], agreement >= g["agreement"], F.col("degree") >= g["degree"], F.col("age_hours") >= g["age"]]
    passed = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    out = candidates.select("id", passed.alias("passed")).withColumn("score", F.col("passed") / len(tests)).withColumn("promote", F.col("passed") == len(tests))
    return out if limit is None else out.orderBy(F.desc("promote"), F.desc("score"), "id").limit(limit)


def lint_pages(pages: DataFrame, hashes: DataFrame) -> DataFrame:
    """(code, id): stale (a source's hash has changed), orphaned (no backlinks, not a source), broken supersession, inconsistent decay.

    pages(id, kind, freshness, decay_score, superseded_by, backlinks, source_hashes map); hashes(source_id, hash).
    """
    stale = pages.select("id", F.explode("source_hashes").alias("source_id", "old")).join(hashes, "source_id").where(~F.col("old").eqNullSafe(F.col("hash"))).select(F.lit("stale_page").alias("code"), "id").distinct()
    orphan = pages.where((F.size("backlinks") <= 0) & (F.col("kind") != "source")).select(F.lit("orphan_page").alias("code"), "id")
    broken = pages.where("superseded_by is not null").select("id", F.col("superseded_by").alias("to")).join(pages.select(F.col("id").alias("to")), "to", "left_anti").select(F.lit("broken_supersession").alias("code"), "id")
    odd = pages.where(((F.col("decay_score") < STALE_BELOW) & (F.col("freshness") == "fresh")) | (F.col("superseded_by").isNotNull() & (F.col("freshness") == "fresh"))).select(F.lit("inconsistent_decay").alias("code"), "id")
    return stale.unionByName(orphan).unionByName(broken).unionByName(odd)


def refresh_status(changed: DataFrame) -> DataFrame:
    """One row from changes (path, change): code and other changes, and the advised action."""
    is_code = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).isin("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "kt", "c", "h", "cpp", "cs", "rb", "php", "scala", "swift", "sql", "sh")
    real = F.col("change") != "unchanged"
    counts = changed.agg(F.count_if(real & is_code).alias("code"), F.count_if(real & ~is_code).alias("other"))
    return counts.withColumn("action", F.when(F.col("code") + F.col("other") == 0, "none").when(F.col("other") == 0, "code_update").otherwise("compile"))
