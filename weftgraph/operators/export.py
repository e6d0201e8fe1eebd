"""Exports of a graph as lines of text, the index manifest, writes that happen only on change, and append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): one element of GraphML for each node and edge; header and footer are constant and left to the writer."""
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), T.xml_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>"))
    quoted = lambda c: F.concat(F.lit('"'), T.xml_escape(F.col(c)), F.lit('"'))
    node = F.concat(F.lit("<node id="), quoted("id"), F.lit(">"), data("label", "label"), data("type", "type"), F.lit("</node>"))
    edge = F.concat(F.lit("<edge id="), quoted("id"), F.lit(" source="), quoted("source"), F.lit(" target="), quoted("target"), F.lit(">"), data("relation", "relation"), data("evidence", "evidence_class"), F.lit("</edge>"))
    return nodes.select(F.lit("node").alias("part"), "id", node.alias("line")).unionByName(edges.select(F.lit("edge").alias("part"), "id", edge.alias("line")))


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): a MERGE statement for each node and edge."""
    q = lambda c: T.cypher_literal(F.coalesce(F.col(c).cast("string"), F.lit("")))
    node = F.concat(F.lit("MERGE (n:Node {id: "), q("id"), F.lit("}) SET n.label = "), q("label"), F.lit(", n.type = "), q("type"), F.lit(";"))
    edge = F.concat(F.lit("MATCH (a:Node {id: "), q("source"), F.lit("}), (b:Node {id: "), q("target"), F.lit("}) MERGE (a)-[r:"), T.relation_type(F.col("relation")), F.lit(" {id: "), q("id"), F.lit("}]->(b);"))
    return nodes.select(F.lit("node").alias("part"), "id", node.alias("line")).unionByName(edges.select(F.lit("edge").alias("part"), "id", edge.alias("line")))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): each node and edge as JSON; absent values are left out."""
    whole = lambda df: F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return nodes.select(F.lit("node").alias("part"), "id", whole(nodes).alias("line")).unionByName(edges.select(F.lit("edge").alias("part"), "id", whole(edges).alias("line")))


def svg_circles(layout: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, line): a circle with a title for each node of a layout (node_id, x, y)."""
    line = F.concat(F.lit('<circle cx="'), F.col("x").cast("string"), F.lit('" cy="'), F.col("y").cast("string"), F.lit('" r="6"><title>'), T.xml_escape(F.col("label")), F.lit("</title></circle>"))
    return layout.join(nodes.select(F.col("id").alias("node_id"), "label"), "node_id").select(F.col("node_id").alias("id"), line.alias("line"))


def page_json_ld(pages: DataFrame) -> DataFrame:
    """(id, json_ld) of pages (id, title, url): a schema.org article each."""
    body = F.create_map(F.lit("@context"), F.lit("https://schema.org"), F.lit("@type"), F.lit("Article"), F.lit("name"), F.col("title"), F.lit("url"), F.col("url"))
    return pages.select("id", F.to_json(body).alias("json_ld"))


def llms_index(pages: DataFrame) -> DataFrame:
    """(kind, line) of pages (title, path, kind): a list entry with a link for each."""
    return pages.select("kind", F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")")).alias("line"))


def manifest(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """One row (n, digest) that changes with any row but not with their order: hashes of the rows, summed as decimals in each task first."""
    each = F.xxhash64(F.col(key), value).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("digest"))


def index_status(stored: DataFrame, now: DataFrame) -> DataFrame:
    """One row: ``missing``, ``stale`` or ``current`` of the stored manifest against that of the pages now; what to do about it."""
    old = stored.limit(1).select(F.col("n").alias("_n"), F.col("digest").alias("_d"))
    status = F.when(F.col("_d").isNull(), "missing").when((F.col("_d") == F.col("digest")) & (F.col("_n") == F.col("n")), "current").otherwise("stale")
    return now.join(old, F.lit(True), "left").select(status.alias("status")).withColumn("action", F.when(F.col("status") == "current", "none").otherwise("rebuild"))  # one row each


def changed_rows(new: DataFrame, stored: DataFrame | None, key: str) -> DataFrame:
    """The rows of new that are not in stored with the same content: what a writer has to write."""
    if stored is None:
        return new
    content = F.xxhash64(*[F.col(c) for c in sorted(new.columns)])
    return new.withColumn("_h", content).join(stored.select(*sorted(new.columns)).select(key, content.alias("_h")), [key, "_h"], "left_anti").drop("_h")


def append_log(spark, path: str, kind: str, **fields) -> None:
    """One record of an operation, appended to a log table."""
    spark.createDataFrame([(kind, {k: str(v) for k, v in fields.items()})], "kind string, fields map<string,string>").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
