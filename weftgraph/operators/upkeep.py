"""Upkeep: lint by tiers and in depth, approvals, promotion runs, tasks and their graph."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.diff import common
from weftgraph.functions.text import truncate
from weftgraph.operators.lifecycle import lint_pages, promotion
from weftgraph.operators.reports import placed
from weftgraph.sources.formats import front_matter

SEVERITY = {"stale_working_tier": "info", "broken_consolidation_basis": "warning", "semantic_without_episodic_basis": "warning", "contradiction": "warning", "stale_page": "warning", "orphan_page": "info", "broken_supersession": "error", "inconsistent_decay": "warning", "coverage_gap": "warning", "missing_citation": "warning", "follow_up_question": "info"}


# Front-matter keys that only the engine writes.
PROTECTED = ("page_id", "source_ids", "node_ids", "freshness", "source_hashes", "source_semantic_hashes", "schema_hash")


def _found(df: DataFrame, code: str, item: str = "id") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(item).cast("string").alias("item"))


def tier_lint(pages: DataFrame, now: Column, window_hours: float = 24.0) -> DataFrame:
    """(code, item) of insight pages (id, kind, tier, updated_at, superseded_by, from_ids): working ones left longer than two windows, tiers built on pages that are gone, semantic ones built on none."""
    own = pages.where("kind = 'insight'").withColumn("tier", F.coalesce("tier", F.lit("working")))
    late = own.where((F.col("tier") == "working") & F.col("superseded_by").isNull() & (F.unix_micros("updated_at") < F.unix_micros(now) - int(window_hours * 2 * 3.6e9)))
    upper = own.where(F.col("tier").isin("episodic", "semantic", "procedural"))
    gone = upper.select("id", F.explode("from_ids").alias("below")).join(pages.select(F.col("id").alias("below")), "below", "left_anti").select("id").distinct()
    bare = own.where((F.col("tier") == "semantic") & (F.coalesce(F.size("from_ids"), F.lit(0)) <= 0))
    return reduce(DataFrame.unionByName, [_found(late, "stale_working_tier"), _found(gone, "broken_consolidation_basis"), _found(bare, "semantic_without_episodic_basis")])


def conflict_lint(edges: DataFrame) -> DataFrame:
    """(code, item) of links that contradict."""
    return _found(edges.where("relation = 'contradicts'"), "contradiction")


def uncited_claims(claims: DataFrame) -> DataFrame:
    """(code, item): pages with claims (page_id, citation) of which one has no citation."""
    return _found(claims.where("citation is null or trim(citation) = ''").select("page_id").distinct(), "uncited_claims", "page_id")


def deep_lint(pages: DataFrame, claims: DataFrame, communities: DataFrame, hubs: DataFrame) -> DataFrame:
    """(code, item): pages (id, kind, title) without claims (page_id, citation), the first five with uncited ones, follow-ups for the first three sources, thin communities (id, size) and hubs (id, bridge_score) that bridge."""
    empty = pages.join(claims.select(F.col("page_id").alias("id")), "id", "left_anti")
    cited = placed(uncited_claims(claims).select(F.col("item").alias("id")), 5, "id")
    first = placed(pages.where("kind = 'source'").select("id"), 3, "id")
    thin = placed(communities.where("size <= 2").select("id", "size"), 3, F.desc("size"), "id")
    spans = placed(hubs.where("bridge_score > 1").select("id", "bridge_score"), 3, F.desc("bridge_score"), "id")
    parts = [_found(empty, "coverage_gap"), _found(cited, "missing_citation"), _found(first, "follow_up_question"), _found(thin, "coverage_gap"), _found(spans, "follow_up_question")]
    return reduce(DataFrame.unionByName, parts).distinct()


def lint(pages: DataFrame, hashes: DataFrame, edges: DataFrame, now: Column, mode: str = "full") -> DataFrame:
    """(code, item, severity): ``conflicts``, ``decay`` or ``tiers`` only, or everything."""
    structure = lint_pages(pages, hashes).select("code", F.col("id").cast("string").alias("item"))
    parts = {"conflicts": [conflict_lint(edges)], "tiers": [tier_lint(pages, now)], "decay": [structure.where(F.col("code").isin("broken_supersession", "inconsistent_decay"))], "full": [structure, tier_lint(pages, now), conflict_lint(edges)]}[mode]
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return reduce(DataFrame.unionByName, parts).withColumn("severity", F.coalesce(severity[F.col("code")], F.lit("info")))


def doctor(checks: DataFrame) -> DataFrame:
    """One row of checks (id, status): the worst status and how many checks have each."""
    return checks.agg(
        F.when(F.max((F.col("status") == "error").cast("int")) == 1, "error").when(F.max((F.col("status") == "warning").cast("int")) == 1, "warning").otherwise("ok").alias("status"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "error")],
    )


def approval_summary(entries: DataFrame) -> DataFrame:
    """(approval_id, entries, pending, accepted, rejected) of entries (approval_id, page_id, status)."""
    return entries.groupBy("approval_id").agg(F.count("*").alias("entries"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "accepted", "rejected")])


def decide_entries(entries: DataFrame, targets: DataFrame, status: str) -> DataFrame:
    """entries with the pending ones among targets (approval_id, page_id) accepted or rejected; decided ones stay."""
    hit = targets.select("approval_id", "page_id").distinct().withColumn("_hit", F.lit(True))
    return entries.join(hit, ["approval_id", "page_id"], "left").withColumn("status", F.when(F.col("_hit") & (F.col("status") == "pending"), status).otherwise(F.col("status"))).drop("_hit")


def promotion_run(candidates: DataFrame, most: int = 25, dry_run: bool = False) -> DataFrame:
    """(id, score, action) of all candidates: the first ``most`` that pass every gate are promoted (or would be), the others kept."""
    judged = promotion(candidates, limit=None)
    first = placed(judged.where("promote").select("id", "score"), most, F.desc("score"), "id").select("id", F.lit("would_promote" if dry_run else "promote").alias("_a"))
    return judged.join(F.broadcast(first), "id", "left").select("id", "score", F.coalesce("_a", F.lit("keep")).alias("action"))  # at most ``most`` rows are broadcast


def candidate_status(now: DataFrame, before: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, status): candidates (id, source_ids) seen in the compile before with sources that are alike become active."""
    both = now.join(before.select("id", F.col("source_ids").alias("_old")), "id", "left")
    union = F.size(F.array_union("source_ids", "_old"))
    alike = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("source_ids", "_old")) / union)
    return both.select("id", F.when(F.col("_old").isNotNull() & (alike >= least), "active").otherwise("candidate").alias("status"))


def tasks_of_events(events: DataFrame) -> DataFrame:
    """(task_id, title, status, notes, decisions, updated_at): the ledger's events (task_id, seq, at, kind, text, status) folded to the latest state; texts in order."""
    told = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "text")))), lambda x: x["text"])
    return events.groupBy("task_id").agg(
        F.max_by(F.when(F.col("kind") == "title", F.col("text")), F.when(F.col("kind") == "title", F.col("seq"))).alias("title"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"),
        told("note").alias("notes"), told("decision").alias("decisions"), F.max("at").alias("updated_at"),
    )


def task_graph(tasks: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, freshness, confidence) and edges (id, source, target, relation, evidence_class, confidence) of tasks (id, title, status, decisions, node_ids, changed_paths, outcome, follow_ups).

    A changed path touches the nodes of the page (path, node_ids) with that path, else of the first one whose path ends with it.
    """
    own = tasks.withColumn("task", F.concat(F.lit("memory:"), F.col("id").cast("string")))
    done = F.col("status").isin("completed", "archived")
    decided = own.select("task", "id", F.posexplode("decisions").alias("at", "text")).withColumn("node", F.concat(F.lit("decision:"), F.col("id").cast("string"), F.lit(":"), (F.col("at") + 1).cast("string")))
    later = own.select("task", "id", F.posexplode("follow_ups").alias("at", "text")).withColumn("node", F.concat(F.lit("decision:"), F.col("id").cast("string"), F.lit(":follow-up-"), (F.col("at") + 1).cast("string")))
    node = lambda df, id_, kind, label, fresh, c: df.select(F.col(id_).alias("id"), F.lit(kind).alias("type"), label.alias("label"), fresh.alias("freshness"), F.lit(c).alias("confidence"))
    nodes = [node(own, "task", "memory_task", F.col("title"), F.when(done, "fresh").otherwise("stale"), 1.0), node(decided, "node", "decision", truncate(F.col("text"), 80), F.lit("fresh"), 1.0), node(later, "node", "decision", truncate(F.concat(F.lit("Follow-up: "), "text"), 80), F.lit("stale"), 0.82)]
    used = own.select("task", "outcome", F.posexplode("node_ids").alias("at", "node")).where("node <> task")

    def edge(df: DataFrame, relation: str, evidence: str, c: float) -> DataFrame:
        return df.select(F.concat("task", F.lit("->"), "node", F.lit(f":{relation}:"), (F.col("at") + 1).cast("string")).alias("id"), F.col("task").alias("source"), F.col("node").alias("target"), F.lit(relation).alias("relation"), F.lit(evidence).alias("evidence_class"), F.lit(c).alias("confidence"))

    edges = [edge(decided, "records_decision", "extracted", 1.0), edge(used, "uses_context", "extracted", 0.9), edge(used.where("outcome is not null and at < 12"), "produced_output", "inferred", 0.68), edge(later, "follows_up", "inferred", 0.82)]
    if pages is not None:
        changed = own.select("task", F.explode("changed_paths").alias("path"))
        touched = page_of_path(changed, pages).select("task", F.explode("node_ids").alias("node")).distinct().withColumn("at", F.row_number().over(Window.partitionBy("task").orderBy("node")) - 1)
        edges.append(edge(touched, "touched", "extracted", 0.85))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges).dropDuplicates(["id"])


def page_of_path(changed: DataFrame, pages: DataFrame) -> DataFrame:
    """changed (path, ...) with the node_ids of its page: the one with that path, else the first by path that ends with it. Every ending of a page's path that begins at a slash is a key, so it is an equi join."""
    parts = F.split("path", "/")
    keyed = pages.select(F.col("path").alias("_full"), "node_ids", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts) - n + 1), "/"))).alias("path"))
    best = keyed.groupBy("path").agg(F.min(F.struct((F.col("_full") != F.col("path")).alias("partial"), F.col("_full").alias("full"), "node_ids")).alias("x")).select("path", "x.node_ids")
    return changed.join(best, "path")


def line_changes(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with added, removed (lines outside a longest common subsequence) and summary of the change of a page's text; null before: a new page, null after: a removed one."""

    def counts(a: str | None, b: str | None) -> tuple[int, int, str]:
        if a is None or b is None:
            text = b if a is None else a
            n = len((text or "").split("\n"))
            return (n, 0, "New page") if a is None else (0, n, "Removed page")
        x, y = a.split("\n"), b.split("\n")
        same = common(x, y)
        more = len(b.strip().split("\n")) - len(a.strip().split("\n"))
        said = f"added {more} line(s)" if more > 0 else f"removed {-more} line(s)" if more < 0 else "modified content" if a != b else "no visible changes"
        return len(y) - same, len(x) - same, said

    @F.pandas_udf("added long, removed long, summary string")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(None if pd.isna(p) else p, None if pd.isna(q) else q) for p, q in zip(a, b, strict=True)], columns=["added", "removed", "summary"])

    return pairs.withColumn("_c", compare(before, after)).select(*pairs.columns, "_c.added", "_c.removed", "_c.summary")


def page_changes(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with the structured change of a page: added and removed lines of the body, changes of the front matter (key, before, after, protected) by key, and a summary; null before: a new page, null after: a removed one."""

    def change(a: str | None, b: str | None) -> tuple:
        (old, body), (new, text) = front_matter(a), front_matter(b)
        x, y = body.split("\n"), text.split("\n")
        same = common(x, y)
        fields = [{"key": k, "before": old.get(k), "after": new.get(k), "protected": k in PROTECTED} for k in sorted(old.keys() | new.keys()) if old.get(k) != new.get(k)]
        if a is None or b is None:
            said = "New page" if a is None else "Removed page"
        else:
            tags = [set(t for t in d.get("tags", "").split(",") if t) for d in (old, new)]
            delta = len(text.strip().split("\n")) - len(body.strip().split("\n"))
            parts = [f"added {len(tags[1] - tags[0])} tag(s)"] * bool(tags[1] - tags[0]) + [f"removed {len(tags[0] - tags[1])} tag(s)"] * bool(tags[0] - tags[1]) + ["updated title"] * (old.get("title") != new.get("title"))
            parts += [f"added {delta} line(s)"] if delta > 0 else [f"removed {-delta} line(s)"] if delta < 0 else ["modified content"] if body != text else []
            said = ", ".join(parts) or "no visible changes"
        return len(y) - same, len(x) - same, fields, said

    @F.pandas_udf("added long, removed long, fields array<struct<key:string,before:string,after:string,protected:boolean>>, summary string")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([change(None if pd.isna(p) else p, None if pd.isna(q) else q) for p, q in zip(a, b, strict=True)], columns=["added", "removed", "fields", "summary"])

    return pairs.withColumn("_c", compare(before, after)).select(*pairs.columns, "_c.added", "_c.removed", "_c.fields", "_c.summary")


def review_buckets(pages: DataFrame, scope: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, bucket) of pages (id, source_ids) that touch scope (source_id): conflicting if in conflicts (id), new if all their sources are in scope, else reinforcing."""
    inside = pages.select("id", F.explode(F.array_distinct("source_ids")).alias("source_id")).join(scope.select("source_id").distinct().withColumn("_in", F.lit(1)), "source_id", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("_in").alias("own"))
    bad = conflicts.select("id").distinct().withColumn("_bad", F.lit(True))
    return inside.where("own > 0").join(bad, "id", "left").select("id", F.when(F.col("_bad"), "conflicting").when(F.col("own") == F.col("n"), "new").otherwise("reinforcing").alias("bucket"))
