"""Questions to subgraphs, many at once: matches, seeds, bounded walks, what a walk costs as context.

Matching never compares all questions with all labels: distinct texts meet, a
question's and a label's, if they share a word, or if the label holds the
question's first three letters and so may hold all of it. A walk's state is one row a question, bounded by its
budget: queue, visited nodes, edges seen, and the neighbours fetched so far. A
step fetches the neighbours of all nodes that any question waits for in one join
(edges of other nodes are read, but not sorted or moved), then every question goes on, in its own order, as far as it has neighbours.

A node's neighbours are kept in their order (confidence, relation, edge) up to the
last that a walk of the budget could look at; hubs are cut in salted parts first,
so no task sorts all edges of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from weftgraph.functions import text as T
from weftgraph.operators.graph import Graph
from weftgraph.operators.traverse import steps
from weftgraph.session import bounded_broadcast, written

MATCHES, LEAST, MOST, SALT = 12, 3, 50, 16
KINDS = ("page", "node", "hyperedge")


def _normal(c):
    return F.lower(T.normalize_whitespace(F.coalesce(c, F.lit(""))))


def matches(g: Graph, questions: DataFrame, limit: int = MATCHES) -> DataFrame:
    """(query_id, rank, kind, id, label, score): the best pages, nodes and hyperedges of each of questions (query_id, text), by score, then label."""
    said = lambda df, kind, label, *fields: df.select(F.lit(KINDS.index(kind)).alias("kind"), "id", F.col(label).alias("label"), F.explode(F.array(*[F.col(f) for f in fields])).alias("said"))
    parts = [said(g.nodes, "node", "label", "label", "id")]
    if g.pages is not None:
        parts.append(said(g.pages, "page", "title", "title", "path"))
    if g.hyperedges is not None:
        own = g.hyperedges.select("id", *[(F.col(c) if c in g.hyperedges.columns else F.lit("")).alias(c) for c in ("label", "why", "relation")])
        parts.append(said(own, "hyperedge", "label", "label", "why", "relation"))
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.unionByName(p)
    labels = written(labels.withColumn("said", _normal(F.col("said"))).where("said <> ''").distinct(), "labels")
    asked = questions.select("query_id", _normal(F.col("text")).alias("q")).where("q <> ''")
    runs = lambda n: F.when(F.length("said") >= n, F.transform(F.sequence(F.lit(1), F.length("said") - (n - 1)), lambda i: F.substring("said", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.concat(*[runs(n) for n in (1, 2, 3)])
    entity = F.struct("label", "kind", "id")
    # A score depends on the two texts only: each text of a question meets each text of a label once, whatever the number of questions and nodes that have it.
    texts = labels.groupBy("said").agg(F.min(entity).alias("first"))
    held = texts.select("*", F.explode(F.array_distinct(F.concat(F.transform(F.split("said", " "), lambda w: F.concat(F.lit("w"), w)), F.transform(grams, lambda x: F.concat(F.lit("g"), x))))).alias("key"))
    keys = written(asked.select("q").distinct().select("q", F.explode(F.array_distinct(F.concat(F.transform(F.split("q", " "), lambda w: F.concat(F.lit("w"), w)), F.array(F.concat(F.lit("g"), F.substring("q", 1, 3)))))).alias("key")), "keys")
    held = held.join(bounded_broadcast(keys.select("key").distinct()), "key", "left_semi")
    met = held.join(keys, "key").select("q", "said", "first").distinct().withColumn("score", T.match_score(F.col("q"), F.col("said"))).where("score > 0")
    met = written(met.withColumn("at", F.struct((-F.col("score")).alias("s"), "first")), "met")
    # Behind the last of the first ``limit`` texts' first entities nothing is among the best; of entities with one text, label and kind the first ``limit`` are enough.
    firsts = met.groupBy("q", "first").agg(F.min("at").alias("at")).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("at"))).where(F.col("n") <= limit)
    last = firsts.groupBy("q").agg(F.max("at").alias("last"), F.max("n").alias("n"))
    near = written(met.join(last, "q").where((F.col("at") <= F.col("last")) | (F.col("n") < limit)).select("q", "said", "score"), "near")
    same = labels.join(bounded_broadcast(near.select("said").distinct()), "said", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("said", "label", "kind").orderBy("id"))).where(F.col("n") <= limit).drop("n")
    best = near.join(same, "said").groupBy("q", "kind", "id", "label").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "label", "kind", "id"))).where(F.col("rank") <= limit)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return asked.join(ranked, "q").select("query_id", "rank", name.alias("kind"), "id", "label", "score")


def seeds(g: Graph, found: DataFrame, budget: int) -> DataFrame:
    """(query_id, seeds): where each question starts, in order: nodes of its pages, its nodes, nodes of its hyperedges; each once, and no more than a walk of the budget can tell apart."""
    own = found.where("kind = 'node'").select("query_id", F.lit(1).alias("part"), "rank", F.lit(0).alias("place"), "id")
    if g.pages is not None:
        first = g.nodes.where("page_id is not null").select("page_id", F.col("id").alias("node"))
        # Of a page of many nodes the first and the last ones: a walk takes seeds from one end.
        count, place = F.count("*").over(Window.partitionBy("page_id")), F.row_number().over(Window.partitionBy("page_id").orderBy("node"))
        first = first.withColumn("place", place).withColumn("_n", count).where((F.col("place") <= 3 * budget) | (F.col("place") > F.col("_n") - 3 * budget))
        own = own.unionByName(found.where("kind = 'page'").join(first, F.col("id") == F.col("page_id")).select("query_id", F.lit(0).alias("part"), "rank", "place", F.col("node").alias("id")))
    if g.hyperedges is not None:
        ends = g.hyperedges.select(F.col("id").alias("hyper"), F.posexplode("node_ids").alias("place", "node"), F.size("node_ids").alias("_n")).where((F.col("place") < 3 * budget) | (F.col("place") >= F.col("_n") - 3 * budget))
        own = own.unionByName(found.where("kind = 'hyperedge'").join(ends, F.col("id") == F.col("hyper")).select("query_id", F.lit(2).alias("part"), "rank", "place", F.col("node").alias("id")))
    once = own.groupBy("query_id", "id").agg(F.min(F.struct("part", "rank", "place")).alias("at"))
    return once.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("seeds"))


def neighbours(edges: DataFrame, budget: int, of: DataFrame | None = None) -> DataFrame:
    """(id, near): each node's steps (neighbor, edge_id) in order, as far as a walk of the budget can look; of all nodes, or of those in ``of`` (id, each once)."""
    order = [F.desc("confidence"), F.col("relation"), F.col("edge_id"), F.col("neighbor")]
    most = 3 * budget

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        # Up to the place at which so many different neighbours have come.
        new = Window.partitionBy(*by, "neighbor").orderBy(*order)
        first = rows.withColumn("_first", (F.row_number().over(new) == 1).cast("int"))
        return first.withColumn("_different", F.sum("_first").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_different") <= most).drop("_first", "_different")

    ways = steps(edges) if of is None else steps(edges).join(bounded_broadcast(of), "id", "left_semi")
    both = ways.withColumn("salt", F.pmod(F.xxhash64("neighbor"), F.lit(SALT)))
    kept = cut(cut(both, "id", "salt"), "id")
    packed = F.struct((-F.col("confidence")).alias("c"), "relation", "edge_id", "neighbor")
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: F.struct(x["neighbor"].alias("neighbor"), x["edge_id"].alias("edge_id"))).alias("near"))


def _go_on(budget: int, depth_first: bool):
    """States of questions, each with the neighbours fetched for it: all go on until done or until they wait for a node."""

    def walk(row: dict) -> dict:
        queue, visited, edges = list(row["queue"]), list(row["visited"]), dict.fromkeys(row["edges"])
        known = {x["id"]: x["near"] for x in row["known"]}
        known |= {x["id"]: x["near"] for x in row["fetched"] or ()}
        known |= {i: [] for i in row["wanted"] if i not in known}  # asked for, not found: no neighbours
        seen = set(visited)
        while queue and len(visited) < budget:
            now = queue[-1] if depth_first else queue[0]
            if now not in seen and now not in known:
                break
            queue.pop() if depth_first else queue.pop(0)
            if now in seen:
                continue
            seen.add(now)
            visited.append(now)
            for step in known[now]:
                edges[step["edge_id"]] = None
                if step["neighbor"] not in seen:
                    queue.append(step["neighbor"])
                if len(visited) + len(queue) >= 2 * budget:
                    break
        done = not queue or len(visited) >= budget
        left = budget - len(visited)
        next_up = [] if done else [i for i in dict.fromkeys(reversed(queue) if depth_first else queue) if i not in seen and i not in known][:left]
        return {
            "query_id": row["query_id"], "queue": [] if done else queue, "visited": visited, "edges": list(edges), "wanted": next_up, "done": done,
            "known": [] if done else [{"id": i, "near": n} for i, n in known.items() if i not in seen],
        }

    def go(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([walk(r) for r in batch.to_pylist()], schema=schema)

    return go


def walks(edges: DataFrame, starts: DataFrame, budget: int = 12, depth_first: bool = False) -> DataFrame:
    """(query_id, seeds, visited, edges): the walk of each of starts (query_id, seeds), ``budget`` (3 to 50) nodes at most."""
    budget = max(LEAST, min(MOST, budget))
    step = neighbours(edges, budget).schema["near"].dataType.simpleString()
    kind = starts.schema["query_id"].dataType.simpleString()
    fetch = f"array<struct<id:string,near:{step}>>"
    state_kind = f"query_id {kind}, queue array<string>, visited array<string>, edges array<string>, wanted array<string>, done boolean, known {fetch}"
    none, some = F.array().cast("array<string>"), 3 * budget
    queue = F.when(F.size("seeds") > some, F.slice("seeds", -some, some) if depth_first else F.slice("seeds", 1, some)).otherwise(F.col("seeds"))
    first = F.slice(F.reverse("queue") if depth_first else F.col("queue"), 1, budget)
    state = written(starts.select("query_id", queue.alias("queue")).select("query_id", "queue", none.alias("visited"), none.alias("edges"), first.alias("wanted"), (F.size("queue") == 0).alias("done"), F.array().cast(fetch).alias("known")), "walks")
    ended = state.where("done")
    open_ = state.where("not done")
    arrow = to_arrow_schema(StructType.fromDDL(state_kind))
    go = _go_on(budget, depth_first)
    for _ in range(MOST + 1):  # each step visits one more node of every open walk at least
        if not open_.limit(1).count():
            break
        # Only the nodes that walks wait for are looked up: no task sorts the edges of the whole graph.
        wanted = open_.select("query_id", F.explode("wanted").alias("id"))
        asked = wanted.join(neighbours(edges, budget, wanted.select("id").distinct()), "id").groupBy("query_id").agg(F.collect_list(F.struct("id", "near")).alias("fetched"))
        after = written(open_.join(asked, "query_id", "left").mapInArrow(lambda batches: go(batches, arrow), state_kind), "walks")
        ended, open_ = ended.unionByName(after.where("done")), after.where("not done")
    return starts.join(ended.select("query_id", "visited", "edges"), "query_id").select("query_id", "seeds", "visited", "edges")


def ask(g: Graph, questions: DataFrame, budget: int = 12, depth_first: bool = False) -> DataFrame:
    """(query_id, seeds, visited, edges, pages, communities, hyperedges) of questions (query_id, text); a question without matches has empty lists.

    pages are those that match and those of visited nodes, in that order; communities and hyperedges are those of visited nodes.
    """
    # A walk depends on its question's text only: questions of one text share a walk, known by the text.
    said = questions.select("query_id", _normal(F.col("text")).alias("_q"))
    questions = written(said.select(F.col("_q").alias("query_id"), F.col("_q").alias("text")).distinct(), "questions")
    found = written(matches(g, questions), "matches")
    starts = questions.select("query_id").join(seeds(g, found, max(LEAST, min(MOST, budget))), "query_id", "left").withColumn("seeds", F.coalesce("seeds", F.array().cast("array<string>")))
    went = written(walks(g.edges, starts, budget, depth_first), "went")
    visits = went.select("query_id", F.posexplode("visited").alias("at", "id"))
    own = written(visits.join(g.nodes.select("id", *[c for c in ("page_id", "community_id") if c in g.nodes.columns]), "id"), "visits")
    ordered = lambda df, name: df.groupBy("query_id", "x").agg(F.min("at").alias("at")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(name))
    hit = found.where("kind = 'page'").select("query_id", (F.col("rank") - 1_000_000).alias("at"), F.col("id").alias("x"))
    pages = hit if "page_id" not in own.columns else hit.unionByName(own.where("page_id is not null").select("query_id", "at", F.col("page_id").alias("x")))
    out = went.join(ordered(pages, "pages"), "query_id", "left")
    if "community_id" in own.columns:
        out = out.join(ordered(own.where("community_id is not null").select("query_id", "at", F.col("community_id").alias("x")), "communities"), "query_id", "left")
    if g.hyperedges is not None:
        held = g.hyperedges.select(F.col("id").alias("x"), F.explode("node_ids").alias("id"))
        out = out.join(ordered(visits.join(held, "id").select("query_id", F.lit(0).alias("at"), "x"), "hyperedges"), "query_id", "left")
    none = F.array().cast("array<string>")
    out = out.select(F.col("query_id").alias("_q"), "seeds", "visited", "edges", *[(F.coalesce(c, none) if c in out.columns else none).alias(c) for c in ("pages", "communities", "hyperedges")])
    return said.join(written(out, "answers"), "_q").drop("_q")


def context(g: Graph, went: DataFrame, bodies: DataFrame | None = None, opening: int = 280) -> DataFrame:
    """(query_id, lines, tokens): what a walk (as ``ask`` gives it) says as text, a line for each page, node and edge, and its cost; bodies (id, body) add the pages' openings."""
    part = lambda name, n: went.select("query_id", F.posexplode(name).alias("at", "id")).withColumn("part", F.lit(n))
    column = lambda df, c, other: F.coalesce(F.col(c), F.lit(other)) if c in df.columns else F.lit(other)
    names = g.nodes.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    label = lambda side: F.coalesce(F.col(f"{side}_label"), F.col(side))
    nodes = g.nodes.select("id", F.concat(F.lit("NODE "), "label", F.lit(" type="), "type", F.lit(" community="), column(g.nodes, "community_id", "unassigned"), F.lit(" page="), column(g.nodes, "page_id", "none")).alias("line"))
    ends = g.edges.join(bounded_broadcast(part("edges", 2).select("id").distinct()), "id", "left_semi").select(F.col("id").alias("edge"), "source", "target", "relation", "evidence_class", "confidence")
    walked = part("edges", 2).withColumnRenamed("id", "edge").join(ends, "edge")
    for side in ("source", "target"):
        walked = walked.join(names.select(F.col("_id").alias(side), F.col("_label").alias(f"{side}_label")), side, "left")
    edge_line = F.concat(F.lit("EDGE "), label("source"), F.lit(" --"), "relation", F.lit("/"), "evidence_class", F.lit("/"), F.format_string("%.2f", F.col("confidence")), F.lit("--> "), label("target"))
    lines = part("visited", 1).join(nodes, "id").select("query_id", "part", "at", "line").unionByName(walked.select("query_id", "part", F.lit(0).alias("at"), edge_line.alias("line")))
    if g.pages is not None:
        head = F.concat(F.lit("PAGE "), "title", F.lit(" path="), "path", F.lit(" kind="), column(g.pages, "kind", "page"))
        said = g.pages if bodies is None else g.pages.join(bodies.select("id", F.substring(T.normalize_whitespace(F.coalesce("body", F.lit(""))), 1, opening).alias("_body")), "id", "left")
        line = head if bodies is None else F.when(F.coalesce("_body", F.lit("")) != "", F.concat(head, F.lit("\nPAGE_BODY "), "_body")).otherwise(head)
        lines = lines.unionByName(part("pages", 0).join(said.select("id", line.alias("line")), "id").select("query_id", "part", "at", "line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n")  # bounded by the budget
    told = lines.groupBy("query_id").agg(text.alias("lines"))
    return went.select("query_id").join(told, "query_id", "left").select("query_id", F.coalesce("lines", F.lit("")).alias("lines")).withColumn("tokens", T.estimate_tokens(F.col("lines")))
