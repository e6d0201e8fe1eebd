"""Relational operators over the graph tables: nodes, edges, hyperedges, communities, pages.

nodes(id, type, label, source_class, page_id, language, source_ids array, community_id, ...),
edges(id, source, target, relation, evidence_class, confidence),
hyperedges(id, label, relation, node_ids array, evidence_class, confidence),
communities(id, label, node_ids array). Only the columns an operator names are needed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.scoring import RELATION_GROUPS
from weftgraph.session import bounded_broadcast, narrow_side, written

CLASSES = ("first_party", "third_party", "resource", "generated")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None
    communities: DataFrame | None = None
    pages: DataFrame | None = None
    sources: DataFrame | None = None


def first_wins(df: DataFrame, key: str | list[str], order: Column | list[Column]) -> DataFrame:
    """One row for each key: the first by order."""
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order if isinstance(order, list) else [order])))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def first_of_few(df: DataFrame, key: str, order: Column) -> DataFrame:
    """As ``first_wins`` where hardly any key is repeated: hashes of the keys are counted, and only rows whose hash is there twice move to be ranked."""
    mark = F.xxhash64(key)
    counted = df.select(mark.alias("_mark")).groupBy("_mark").agg(F.count("*").alias("_n")).where("_n > 1").select("_mark")
    twice = written(counted, "twice")
    if twice.isEmpty():
        return df
    twice, marked = bounded_broadcast(twice), df.withColumn("_mark", mark)
    again = first_wins(marked.join(twice, "_mark", "left_semi"), key, order)
    return marked.join(twice, "_mark", "left_anti").unionByName(again).drop("_mark")


def stats(g: Graph) -> DataFrame:
    """(dimension, name, n): nodes by type and class, edges by relation and evidence. A null class counts as first_party."""
    by = lambda df, dimension, c: df.groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(dimension).alias("dimension"), "name", "n")
    evidence = g.edges.select("evidence_class")
    parts = [by(g.nodes, "node_type", F.col("type")), by(g.nodes, "node_class", F.coalesce("source_class", F.lit("first_party"))), by(g.edges, "relation", F.col("relation"))]
    if g.hyperedges is not None:
        evidence = evidence.unionByName(g.hyperedges.select("evidence_class"))
        parts.append(by(g.hyperedges, "hyperedge_relation", F.col("relation")))
    parts.append(by(evidence, "evidence_class", F.col("evidence_class")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_breakdown(nodes: DataFrame) -> DataFrame:
    """One row with a count for each class; a null class counts nowhere."""
    return nodes.agg(*[F.count_if(F.col("source_class") == c).alias(c) for c in CLASSES])


def expand_relations(relations: Iterable[str] = (), groups: Iterable[str] = ()) -> list[str]:
    return sorted({*relations, *(r for g in groups for r in RELATION_GROUPS[g])})


def filter_for_query(g: Graph, relations=(), relation_groups=(), evidence=(), types=(), languages=()) -> Graph:
    """Edges of wanted relations and evidence of which, if node filters are set, an end passes; nodes that pass or that a kept edge has."""
    wanted = expand_relations(relations, relation_groups)
    passes = F.lit(True)
    if types:
        passes = passes & F.coalesce(F.col("type").isin(*types), F.lit(False))
    if languages:
        passes = passes & F.coalesce(F.col("language").isin(*languages), F.lit(False))
    edges = g.edges
    if wanted:
        edges = edges.where(F.col("relation").isin(*wanted))
    if evidence:
        edges = edges.where(F.col("evidence_class").isin(*evidence))
    good = g.nodes.where(passes)
    if types or languages:
        flags = good.select(F.col("id").alias("_id"), F.lit(True).alias("_ok"))
        edges = (
            edges.join(flags.withColumnsRenamed({"_id": "source", "_ok": "_s"}), "source", "left").join(flags.withColumnsRenamed({"_id": "target", "_ok": "_t"}), "target", "left")
            .where(F.col("_s") | F.col("_t")).select(*g.edges.columns)
        )
        touched = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        nodes = g.nodes.join(good.select("id").union(touched).distinct(), "id", "left_semi")
    else:
        nodes = g.nodes
    hyper = g.hyperedges
    if hyper is not None:
        hyper = hyper.join(members(hyper).join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("id").distinct(), "id", "left_semi")
    return Graph(nodes, edges, hyper, g.communities, g.pages, g.sources)


def members(hyperedges: DataFrame) -> DataFrame:
    return hyperedges.select("id", F.explode("node_ids").alias("node_id"))


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = narrow_side(nodes.select("id").distinct())
    return edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns)


def _trimmed(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_ids with only the nodes that are there (order kept), and how many there were."""
    kept = groups.select("id", F.posexplode("node_ids").alias("_at", "node_id")).join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    lists = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "node_id"))), lambda x: x["node_id"]).alias("_kept"))
    return groups.join(lists, "id", "left").withColumn("_before", F.size("node_ids")).withColumn("node_ids", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")


def of_class(g: Graph, wanted: str) -> Graph:
    """Induced subgraph of one class; hyperedges need every member, communities at least one."""
    nodes = g.nodes.where(F.col("source_class") == wanted)
    hyper = None if g.hyperedges is None else _trimmed(g.hyperedges, nodes).where(F.size("node_ids") == F.col("_before")).drop("_before")
    communities = None if g.communities is None else _trimmed(g.communities, nodes).where(F.size("node_ids") > 0).drop("_before")
    return Graph(nodes, prune_dangling(nodes, g.edges), hyper, communities, g.pages, g.sources)


def of_classes(g: Graph, wanted: Iterable[str]) -> Graph:
    """As ``of_class`` for several; hyperedges are trimmed and kept with two members or more. A null class is in none."""
    nodes = g.nodes.where(F.coalesce(F.col("source_class").isin(*wanted), F.lit(False)))
    hyper = None if g.hyperedges is None else _trimmed(g.hyperedges, nodes).where(F.size("node_ids") >= 2).drop("_before")
    return Graph(nodes, prune_dangling(nodes, g.edges), hyper, g.communities, g.pages, g.sources)


def without_sources(g: Graph, removed: DataFrame) -> Graph:
    """Drops nodes all of whose (one or more) sources are in removed(source_id), and edges that lose an end."""
    left = g.nodes.select("id", F.explode("source_ids").alias("source_id")).join(removed.select("source_id"), "source_id", "left_anti").select("id").distinct()
    nodes = g.nodes.where(F.size("source_ids") <= 0).unionByName(g.nodes.where(F.size("source_ids") > 0).join(left, "id", "left_semi"))
    return Graph(nodes, prune_dangling(nodes, g.edges), g.hyperedges, g.communities, g.pages, g.sources)


def diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(change, id): added and removed; each table is counted by key once. A null key equals none."""
    side = lambda df, was: df.select(key, F.lit(was).alias("_was"), F.lit(not was).alias("_is"))
    met = side(before, True).unionByName(side(after, False)).groupBy(key).agg(F.max("_was").alias("_was"), F.max("_is").alias("_is"))
    alone = lambda here, there, name: F.when(F.col(here) & (~F.col(there) | F.col(key).isNull()), name)
    return met.select(F.explode(F.array_compact(F.array(alone("_is", "_was", "added"), alone("_was", "_is", "removed")))).alias("change"), key)


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): created, updated, unchanged or removed by comparing values (null is a value)."""
    b, a = before.select(key, F.col(value).alias("_b"), F.lit(1).alias("_was")), after.select(key, F.col(value).alias("_a"), F.lit(1).alias("_is"))
    kind = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return b.join(a, key, "full_outer").select(key, kind.alias("change"))


def merge(graphs: dict[str, Graph]) -> Graph:
    """Union of graphs, ids prefixed by their name; of a repeated id the first graph's row stays."""
    nodes, edges = [], []
    for at, (name, g) in enumerate(graphs.items()):
        own = lambda c, n=name: F.concat(F.lit(f"{n}:"), F.col(c))
        nodes.append(g.nodes.withColumn("id", own("id")).withColumn("_at", F.lit(at)))
        edges.append(g.edges.withColumns({c: own(c) for c in ("id", "source", "target")}).withColumn("_at", F.lit(at)))
    out = []
    for parts, first in ((nodes, first_wins), (edges, first_of_few)):
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        out.append(first(whole, "id", F.col("_at")).drop("_at"))
    return Graph(*out)


def hubs(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Hyperedges with two visible members or more as a hub node and an edge to each member."""
    seen = _trimmed(g.hyperedges, g.nodes).where(F.size("node_ids") >= 2)
    nodes = seen.select(F.concat(F.lit("hyper:"), "id").alias("id"), F.col("relation").alias("label"), "relation", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.size("node_ids").alias("participants"))
    edges = seen.select("id", "relation", "confidence", F.explode("node_ids").alias("target")).select(
        F.concat_ws(":", F.lit("hyper-edge"), "id", "target").alias("id"), F.concat(F.lit("hyper:"), "id").alias("source"), "target", "relation", F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )
    return nodes, edges


def group_hyperedges(edges: DataFrame, group: str, member: str, relation: str, base: float, step: float, cap: float, least: int = 3) -> DataFrame:
    """A hyperedge for each value of ``group`` with enough distinct members."""
    grouped = edges.groupBy(F.col(group).alias("hub")).agg(F.sort_array(F.collect_set(member)).alias("node_ids")).where(F.size("node_ids") >= least)
    everyone = F.array_join(F.array_sort(F.concat(F.array("hub"), F.col("node_ids"))), "|")
    return grouped.select(
        F.concat(F.lit("hyper:"), F.substring(F.sha2(F.concat(F.lit(f"{relation}|"), everyone), 256), 1, 16)).alias("id"), "hub", F.lit(relation).alias("relation"), "node_ids",
        F.round(F.least(F.lit(cap), base + step * F.size("node_ids")), 6).alias("confidence"),
    )


def topic_hyperedges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts and entities that three sources or more mention."""
    topics, sources = (nodes.where(F.col("type").isin(*t)).select("id") for t in (("concept", "entity"), ("source",)))
    mentions = edges.where("relation = 'mentions'").join(topics.withColumnRenamed("id", "target"), "target", "left_semi").join(sources.withColumnRenamed("id", "source"), "source", "left_semi")
    return group_hyperedges(mentions, "target", "source", "participate_in", 0.72, 0.06, 0.96)


def module_hyperedges(edges: DataFrame) -> DataFrame:
    """Modules that define three symbols or more."""
    return group_hyperedges(edges.where("relation = 'defines'"), "source", "target", "form", 0.78, 0.04, 0.98)


def validate(g: Graph) -> DataFrame:
    """(code, item): duplicate ids, confidences outside 0..1, empty labels and relations, and references to nothing."""
    found = []
    tables = {"node": g.nodes, "edge": g.edges, "hyperedge": g.hyperedges, "community": g.communities, "page": g.pages}
    tables = {k: t for k, t in tables.items() if t is not None}
    for name, t in tables.items():
        found.append(t.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate_{name}_id").alias("code"), F.col("id").alias("item")))
        if "confidence" in t.columns:
            c = F.col("confidence")
            found.append(t.where(c.isNull() | (c < 0) | (c > 1) | F.isnan(c)).select(F.lit("invalid_confidence").alias("code"), F.concat_ws(":", F.lit(name), "id").alias("item")))
    found.append(g.nodes.where(F.trim(F.coalesce("label", F.lit(""))) == "").select(F.lit("empty_label").alias("code"), F.col("id").alias("item")))
    found.append(g.edges.where(F.trim(F.coalesce("relation", F.lit(""))) == "").select(F.lit("empty_relation").alias("code"), F.col("id").alias("item")))
    ids = g.nodes.select(F.col("id").alias("node_id"))
    for side in ("source", "target"):
        found.append(g.edges.select("id", F.col(side).alias("node_id")).join(ids, "node_id", "left_anti").select(F.lit(f"dangling_edge_{side}").alias("code"), F.col("id").alias("item")))
    for name in ("hyperedge", "community"):
        if name in tables:
            found.append(members(tables[name]).join(ids, "node_id", "left_anti").select(F.lit(f"dangling_{name}_node").alias("code"), F.concat_ws(":", "id", "node_id").alias("item")))
    if g.pages is not None:
        pages = g.pages.select(F.col("id").alias("page_id"))
        found.append(g.nodes.where("page_id is not null").select("id", "page_id").join(pages, "page_id", "left_anti").select(F.lit("dangling_node_page").alias("code"), F.col("id").alias("item")))
    if "status" in g.edges.columns:
        wrong = (F.col("status") == "conflicted") & ~F.col("evidence_class").eqNullSafe("ambiguous")
        found.append(g.edges.where(wrong).select(F.lit("conflicted_evidence").alias("code"), F.col("id").alias("item")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def shrink_guard(before: DataFrame, after: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(before, after, drop_ratio, blocked) of two tables' row counts."""
    counts = before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after")))  # one row each
    ratio = F.when(F.col("before") > 0, F.greatest(F.lit(0.0), (F.col("before") - F.col("after")) / F.col("before"))).otherwise(0.0)
    return counts.withColumn("drop_ratio", ratio).withColumn("blocked", F.col("drop_ratio") > threshold)


def list_hyperedges(hyperedges: DataFrame, node_id: str | None = None, limit: int = 25) -> DataFrame:
    found = hyperedges if node_id is None else hyperedges.where(F.array_contains("node_ids", node_id))
    return found.orderBy(F.desc("confidence"), "label").limit(limit)


def primitive_properties(nodes: DataFrame) -> DataFrame:
    """(id, key, value): flat properties, arrays as JSON, absent ones left out."""
    flat = [F.struct(F.lit(f.name).alias("key"), (F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name).cast("string")).alias("value")) for f in nodes.schema if f.name != "id"]
    return nodes.select("id", F.explode(F.array(*flat)).alias("p")).where("p.value is not null").select("id", "p.key", "p.value")


def circular_layout(communities: DataFrame, spacing: float = 400.0) -> DataFrame:
    """(node_id, x, y): communities on a grid, the largest first; the members of each on a circle."""
    ranked = communities.select("id", "node_ids", F.size("node_ids").alias("n")).withColumn("at", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1)  # one row a community
    total = communities.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*")))).alias("side"))
    each = ranked.crossJoin(total).select("n", "at", "side", F.posexplode("node_ids").alias("i", "node_id"))
    angle, radius = 2 * F.pi() * F.col("i") / F.col("n"), F.greatest(F.lit(40.0), 12.0 * F.sqrt("n"))
    return each.select("node_id", F.round(F.col("at") % F.col("side") * spacing + radius * F.cos(angle), 4).alias("x"), F.round(F.floor(F.col("at") / F.col("side")) * spacing + radius * F.sin(angle), 4).alias("y"))
