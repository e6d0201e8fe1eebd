"""Reports over the graph: lists, questions, dashboards, token savings. Lists are short; what they summarise is counted by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.metrics import degrees
from weftgraph.session import narrow_side


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def placed(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows with their rank from 1; only those meet in one task."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_hubs(degree: DataFrame, limit: int = 10) -> DataFrame:
    """(rank, id, degree) of hubs (from ``god_nodes``), by falling degree and id."""
    return placed(degree.where("is_god").select("id", "degree"), limit, F.desc("degree"), "id")


def fragmented(communities: DataFrame, fold_below: int = 3, visible: int = 6, examples: int = 4) -> DataFrame:
    """(id, label, nodes, communities) of communities (id, label, size) smaller than ``fold_below``: the largest ones, and one row (id null) for all others with their number, nodes and first labels."""
    thin = communities.where(F.col("size") < fold_below)
    order = [F.desc("size"), F.col("label")]
    head = placed(thin, visible + examples, *order)
    shown = head.where(F.col("rank") <= visible).select("id", "label", F.col("size").cast("long").alias("nodes"), F.lit(1).cast("long").alias("communities"))
    names = head.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > visible, F.struct("rank", "label")))), lambda x: x["label"]), ", ").alias("label"), F.sum(F.when(F.col("rank") <= visible, F.col("size"))).alias("shown"))
    total = thin.agg(F.count("*").alias("n"), F.sum("size").alias("nodes"))
    rest = total.crossJoin(names).where(F.col("n") > visible).select(F.lit(None).cast("string").alias("id"), "label", (F.col("nodes") - F.col("shown")).cast("long").alias("nodes"), (F.col("n") - visible).alias("communities"))  # one row each
    return shown.unionByName(rest)


def suggested_questions(nodes: DataFrame, edges: DataFrame, communities: DataFrame, limit: int = 8) -> DataFrame:
    """(rank, question) about thin communities, bridges, ambiguous links, hubs with inferred links and isolated nodes; nodes carry label, type, degree, is_god and bridge_score."""
    label = nodes.select("id", "label")
    ask = lambda df, part, before, after: df.select(F.lit(part).alias("part"), "rank", F.concat(F.lit(before), "label", F.lit(after)).alias("question"))
    thin = placed(communities.where("size <= 2").select("id", "label"), limit, "id")
    bridges = placed(nodes.where("bridge_score > 0").select("id", "label", "bridge_score"), 3, F.desc("bridge_score"), "id")
    unclear = placed(edges.where("evidence_class = 'ambiguous'").select("id", "source", "target"), 3, "id")
    ends = unclear.join(label.withColumnsRenamed({"id": "source", "label": "a"}), "source").join(label.withColumnsRenamed({"id": "target", "label": "b"}), "target")
    guessed = edges.where("evidence_class = 'inferred'").select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n >= 2")
    hubs = placed(nodes.where("is_god").select("id", "label").join(guessed, "id", "left_semi"), limit, "id")
    alone = placed(nodes.where("degree <= 1 and type <> 'source'").select("id", "label"), 3, "id")
    asked = _union([
        ask(thin, 1, "What sources would strengthen community ", "?"), ask(bridges, 2, "Why does ", " connect multiple communities in the vault?"),
        ask(ends.withColumn("label", F.concat("a", F.lit(" and "), "b")), 3, "What is the exact relationship between ", "?"), ask(hubs, 4, "Are the inferred relationships involving ", " correct?"), ask(alone, 5, "What connects ", " to the rest of the vault?"),
    ])
    once = asked.groupBy("question").agg(F.min(F.struct("part", "rank")).alias("at"))  # a few rows
    return placed(once, limit, "at").select("rank", "question")


def top_surprising(edges: DataFrame, scores: DataFrame, nodes: DataFrame, limit: int = 8) -> DataFrame:
    """(rank, id, source_label, target_label, relation, score) of links between communities or types, of similar or of ambiguous ones, by falling score, confidence and id. The path that supports one is the link itself."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("label").alias(f"{s}_label"), F.col("community_id").alias(f"{s}_c"), F.col("type").alias(f"{s}_t"))
    both = edges.join(side("source"), "source", "left").join(side("target"), "target", "left").join(scores.select("id", "score"), "id")
    apart = F.coalesce(F.col("source_c") != F.col("target_c"), F.lit(False)) | F.coalesce(F.col("source_t") != F.col("target_t"), F.lit(False))
    wanted = both.where(apart | (F.col("relation") == "semantically_similar_to") | (F.col("evidence_class") == "ambiguous"))
    named = wanted.select("id", F.coalesce("source_label", "source").alias("source_label"), F.coalesce("target_label", "target").alias("target_label"), "relation", "score", "confidence")
    return placed(named, limit, F.desc(F.round("score", 9)), F.desc("confidence"), "id").drop("confidence")


def community_view(nodes: DataFrame, edges: DataFrame, community: str, limit: int = 50) -> DataFrame:
    """(part, rank, id) of one community: its nodes by falling degree, the pages they have, the links inside it. nodes(id, type, community_id, page_id). Only links that touch the community are moved."""
    own = nodes.where(F.col("community_id") == community)
    ids = narrow_side(own.select("id"))
    at = lambda end: ids.withColumnRenamed("id", end)
    near = edges.join(at("source"), "source", "left_semi").select(F.col("source").alias("id"), F.col("target").alias("neighbor")).union(edges.join(at("target"), "target", "left_semi").select("target", "source")).distinct()
    inner = edges.join(at("source"), "source", "left_semi").join(at("target"), "target", "left_semi")
    parts = {"node": placed(degrees(own, near), limit, F.desc("degree"), "id"), "page": placed(own.where("page_id is not null").select(F.col("page_id").alias("id")).distinct(), limit, "id"), "edge": placed(inner.select("id"), limit, "id")}
    return _union([df.select(F.lit(name).alias("part"), "rank", "id") for name, df in parts.items()])


def dashboards(pages: DataFrame, timeline: int = 25, recent: int = 20, research: int = 8) -> DataFrame:
    """(board, rank, id) of pages (id, kind, status, occurred_at, updated_at): the timeline, what changed last, and open research."""
    boards = {
        "timeline": placed(pages.where("occurred_at is not null").select("id", "occurred_at"), timeline, F.desc("occurred_at"), "id"), "recent": placed(pages.select("id", "updated_at"), recent, F.desc("updated_at"), "id"),
        "research": placed(pages.where("kind = 'output' and status <> 'archived'").select("id", "updated_at"), research, F.desc("updated_at"), "id"),
    }
    return _union([df.select(F.lit(name).alias("board"), "rank", "id") for name, df in boards.items()])


def token_reduction(words: DataFrame, questions: DataFrame) -> DataFrame:
    """(class, corpus_tokens, context_tokens, reduction) of corpus words (class, words) and questions (class, tokens): tokens are 4/3 of the words; what a question needs on average saves that share, less than nothing for small corpora."""
    corpus = words.groupBy("class").agg(F.sum("words").alias("w")).select("class", F.when(F.col("w") > 0, F.greatest(F.lit(1), F.round(F.col("w") * 100 / 75))).otherwise(0).cast("long").alias("corpus_tokens"))
    asked = questions.where("tokens > 0").groupBy("class").agg(F.greatest(F.lit(1), F.round(F.avg("tokens"))).cast("long").alias("context_tokens"))
    both = corpus.join(asked, "class", "left").withColumn("context_tokens", F.coalesce("context_tokens", F.lit(0).cast("long")))
    saved = F.when((F.col("context_tokens") > 0) & (F.col("corpus_tokens") > 0), F.round(1 - F.col("context_tokens") / F.greatest(F.lit(1), F.col("corpus_tokens")), 3)).otherwise(0.0)
    return both.withColumn("reduction", saved)


def share(nodes: DataFrame, edges: DataFrame, degree: DataFrame, bridges: DataFrame, hubs: int = 5, spans: int = 3) -> DataFrame:
    """(part, rank, label, value): numbers of nodes and links, the first hubs and the first bridges, for a shared summary."""
    label = nodes.select("id", "label")
    count = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit("overview").alias("part"), F.lit(1).alias("rank"), F.lit(name).alias("label"), "value")
    best = placed(degree.where("is_god").join(label, "id").select("id", "label", F.col("degree").alias("value")), hubs, F.desc("value"), "id").select(F.lit("hub").alias("part"), "rank", "label", "value")
    span = placed(bridges.where("bridge_score > 0").join(label, "id").select("id", "label", F.col("bridge_score").alias("value")), spans, F.desc("value"), "id").select(F.lit("bridge").alias("part"), "rank", "label", "value")
    return _union([count("nodes", nodes), count("edges", edges), best, span])
