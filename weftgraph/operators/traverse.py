"""Traversals: bounded, breadth first, with fixed tie-breaks (confidence, then relation, then id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import match_score
from weftgraph.session import bounded_broadcast


def steps(edges: DataFrame) -> DataFrame:
    """Edges as steps both ways: (id, neighbor, edge_id, relation, confidence)."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbor"), F.col("id").alias("edge_id"), "relation", "confidence")
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("neighbor"), F.col("id").alias("edge_id"), "relation", "confidence")
    return out.unionByName(back)


def reach(edges: DataFrame, start: str, depth: int, direction: str = "both", until: str | None = None) -> DataFrame:
    """(id, depth, parent): least number of steps from start, up to depth; of several parents the smallest id. One join a step, on the frontier only."""
    spark = edges.sparkSession
    edges = edges.select("source", "target").checkpoint()  # once, not at each step; the ends only
    out, back = edges.selectExpr("source as id", "target as neighbor"), edges.selectExpr("target as id", "source as neighbor")
    ways = {"both": out.unionByName(back), "out": out, "in": back}[direction]
    seen = spark.createDataFrame([(start, 0, None)], "id string, depth int, parent string")
    frontier = seen.select("id")
    for at in range(1, depth + 1):
        # Up to the bound the frontier goes to the edges, which stay where they are.
        found = ways.join(bounded_broadcast(frontier), "id").groupBy("neighbor").agg(F.min("id").alias("parent")).withColumnRenamed("neighbor", "id").join(seen.select("id"), "id", "left_anti")
        found = found.select("id", F.lit(at).alias("depth"), "parent").checkpoint()
        if found.isEmpty():
            break
        seen, frontier = seen.unionByName(found), found.select("id")
        if until is not None and not found.where(F.col("id") == until).isEmpty():
            break
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, limit: int = 1_000) -> list[str]:
    """Ids from start to end, [] if there is no path; the search ends where it finds end, or nothing new."""
    found = reach(edges, start, limit, until=end)
    path, at = [], end
    while at is not None:
        row = found.where(F.col("id") == at).select("parent").first()
        if row is None:
            return []
        path.append(at)
        at = row["parent"]
    return path[::-1]


def blast_radius(edges: DataFrame, module: str, depth: int = 3) -> DataFrame:
    """(id, depth): modules that import module, directly or through others."""
    return reach(edges.where("relation = 'imports'"), module, max(1, min(10, depth)), "in").where("depth > 0").select("id", "depth")


def explain(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Neighbours of node with relation and direction, by falling confidence and label."""
    out = edges.where(F.col("source") == node).select(F.col("target").alias("id"), "relation", "confidence", F.lit("out").alias("direction"))
    back = edges.where(F.col("target") == node).select(F.col("source").alias("id"), "relation", "confidence", F.lit("in").alias("direction"))
    return out.unionByName(back).join(nodes.select("id", "label", "type"), "id").orderBy(F.desc("confidence"), "label", "relation")


def resolve(nodes: DataFrame, target: str, limit: int = 1) -> DataFrame:
    """Best matches of a name: an exact id first, then by label score, degree and id."""
    score = F.when(F.col("id") == target, 1000).otherwise(F.greatest(match_score(F.lit(target), F.col("label")), match_score(F.lit(target), F.col("id"))))
    order = [F.desc("score"), *([F.desc("degree")] if "degree" in nodes.columns else []), "id"]
    return nodes.withColumn("score", score).where("score > 0").orderBy(*order).limit(limit)


def query(nodes: DataFrame, edges: DataFrame, question: str, budget: int = 12, depth_first: bool = False) -> DataFrame:
    """(at, id, via): nodes visited from the best matches, ``budget`` (3 to 50) at most; neighbours by falling confidence, then relation, then id.

    The driver holds the frontier (2 x budget ids at most); each step fetches the neighbours of one batch of ids.
    """
    budget = max(3, min(50, budget))
    seeds = [r["id"] for r in resolve(nodes, question, 12).collect()]
    ways = steps(edges)
    queue, seen, visited = [(s, None) for s in seeds], set(seeds), []
    while queue and len(visited) < budget:
        batch = [queue.pop() if depth_first else queue.pop(0)] if depth_first else queue[: budget - len(visited)]
        if not depth_first:
            queue = queue[len(batch) :]
        visited += batch
        top = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "relation", "neighbor"))
        near = ways.where(F.col("id").isin([b[0] for b in batch])).withColumn("rn", top).where(F.col("rn") <= 2 * budget).orderBy("id", "rn").collect()
        of: dict[str, list] = {}
        for r in near:
            of.setdefault(r["id"], []).append((r["neighbor"], r["edge_id"]))
        for b in batch:
            for n, e in of.get(b[0], []):
                if n not in seen and len(queue) < 2 * budget:
                    seen.add(n)
                    queue.append((n, e))
    return nodes.sparkSession.createDataFrame([(i, n, e) for i, (n, e) in enumerate(visited)], "at int, id string, via string")


def path_tree(paths: DataFrame) -> DataFrame:
    """(path, parent, depth, children) of the directories and files of (path)."""
    parts = paths.select(F.split("path", "/").alias("parts")).select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    nodes = parts.select(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"), F.when(F.col("depth") > 1, F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/")).alias("parent"), "depth").distinct()
    return nodes.join(nodes.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children")), "path", "left").withColumn("children", F.coalesce("children", F.lit(0)))
