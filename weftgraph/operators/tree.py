"""The graph as a tree: folders, sources, modules, symbols and rationales, with a bounded number of children each.

Every row knows its folders from the paths, so there is no walk down the tree: a
row is shown if neither it nor anything above it is beyond its parent's limit.
Places among a parent's children are needed only up to the limit and come from
parts of them first, so a folder of very many files is no single sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.session import bounded_broadcast, written

KINDS = ("directory", "source", "module", "symbol", "rationale", "node", "more", "root")
ROOT, MOST, PARTS = "tree:root", 250, 32


def rows(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, parent, kind, label, count, node_id, above): all rows under the root; above: the ids between the root and the row.

    sources (source_id, path, title), nodes (id, type, label, source_ids, module_id). A symbol stands under its module where that is of the same source, else under the source.
    """
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.col("title"), F.col("source_id"))
    prefix = lambda n: F.concat(F.lit(ROOT + "/"), F.array_join(F.slice(parts, 1, n), "/"))
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), prefix)).otherwise(F.array().cast("array<string>"))
    placed = sources.select("source_id", last.alias("label"), folders.alias("folders"))
    by_folder = placed.select(F.posexplode("folders").alias("at", "id"), "folders").groupBy("id").agg(F.count("*").alias("count"), F.any_value("at").alias("at"), F.any_value("folders").alias("folders"))
    directory = by_folder.withColumn("above", F.slice("folders", 1, F.col("at"))).select("id", F.coalesce(F.try_element_at("above", F.lit(-1)), F.lit(ROOT)).alias("parent"), F.lit("directory").alias("kind"), F.try_element_at(F.split("id", "/"), F.lit(-1)).alias("label"), "count", F.lit(None).cast("string").alias("node_id"), "above")
    own = placed.select("source_id", F.concat(F.lit("tree:source:"), F.col("source_id")).alias("sid"), "label", "folders")
    held = nodes.where("type in ('module', 'symbol', 'rationale')").select("id", "type", "label", "module_id", F.explode(F.array_distinct("source_ids")).alias("source_id"))
    modules = held.where("type = 'module'").select(F.col("id").alias("module_id"), "source_id", F.lit(True).alias("there"))
    inside = held.join(modules, ["module_id", "source_id"], "left").withColumn("under", F.when((F.col("type") == "symbol") & F.col("there"), F.concat(F.lit("tree:"), "module_id")))
    direct = inside.where("under is null").groupBy("source_id").agg(F.count("*").alias("count"))
    of_module = inside.where("under is not null").groupBy(F.col("under").alias("id"), "source_id").agg(F.count("*").alias("count"))
    source = own.join(direct, "source_id", "left").select(F.col("sid").alias("id"), F.coalesce(F.try_element_at("folders", F.lit(-1)), F.lit(ROOT)).alias("parent"), F.lit("source").alias("kind"), "label", F.coalesce("count", F.lit(0)).alias("count"), F.lit(None).cast("string").alias("node_id"), F.col("folders").alias("above"))
    named = inside.join(own.select("source_id", "sid", "folders"), "source_id").withColumn("tid", F.concat(F.lit("tree:"), "id"))
    counted = named.join(of_module.withColumnRenamed("id", "tid"), ["tid", "source_id"], "left")
    chain = F.concat("folders", F.array("sid"))
    above = F.when(F.col("under").isNotNull(), F.concat(chain, F.array("under"))).otherwise(chain)
    leaf = counted.select(F.col("tid").alias("id"), F.coalesce("under", "sid").alias("parent"), F.col("type").alias("kind"), "label", F.when(F.col("type") == "module", F.coalesce("count", F.lit(0))).otherwise(F.lit(0)).alias("count"), F.col("id").alias("node_id"), above.alias("above"))
    return directory.unionByName(source).unionByName(leaf)


def capped(tree: DataFrame, most: int = MOST) -> DataFrame:
    """(id, parent, kind, label, count, node_id, rank): the first ``most`` children of each parent by kind, label and id, and one row ``more`` with the number of the others; nothing below a row that is not shown."""
    tree = written(tree, "tree")
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = [F.col("_kind"), F.col("label"), F.col("id")]
    keyed = tree.select("*", kind.alias("_kind"), F.concat_ws(" ", "parent", "id").alias("_row"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("_part"))
    best = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("parent", "_part").orderBy(*order))).where(F.col("_n") <= most)
    shown = written(best.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(*order))).where(F.col("rank") <= most).drop("_n", "_part", "_kind", "_row"), "shown")
    # A row is gone if one above it is not among its parent's first. Only rows that have something below can take others along.
    inner = tree.select("parent").distinct().where(F.col("parent") != ROOT)
    held = tree.select("id", "parent").join(inner.withColumnRenamed("parent", "id"), "id", "left_semi")
    cut = bounded_broadcast(written(held.join(shown.select("id", "parent"), ["id", "parent"], "left_anti").select(F.col("id").alias("gone")).distinct(), "cut"))
    lost = shown.select("id", "parent", F.explode("above").alias("gone")).join(cut, "gone", "left_semi").select("id", "parent").distinct()
    seen = written(shown.join(lost, ["id", "parent"], "left_anti").select("id", "parent", "kind", "label", "count", "node_id", "rank"), "seen")
    hidden = tree.groupBy("parent").agg((F.count("*") - most).alias("hidden")).where("hidden > 0")
    there = seen.select(F.col("id").alias("parent")).distinct().unionByName(tree.sparkSession.createDataFrame([(ROOT,)], "parent string"))
    more = hidden.join(there, "parent", "left_semi").select(F.concat("parent", F.lit(":more")).alias("id"), "parent", F.lit("more").alias("kind"), F.concat(F.lit("+"), F.col("hidden").cast("string"), F.lit(" more")).alias("label"), F.col("hidden").alias("count"), F.lit(None).cast("string").alias("node_id"), F.lit(most + 1).alias("rank"))
    return seen.unionByName(more)


def graph_tree(sources: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """The capped tree of sources and nodes (see ``rows`` and ``capped``)."""
    return capped(rows(sources, nodes), max(1, most))
