"""The test tables read as graph tables. The same SQL text builds them in Spark and in the oracle."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import Graph
from weftgraph.session import written

NODES = """
SELECT 'customer:' || CAST(c_custkey AS STRING) AS id, 'source' AS type, c_name AS label, CASE c_mktsegment WHEN 'BUILDING' THEN 'first_party' WHEN 'AUTOMOBILE' THEN 'third_party' WHEN 'MACHINERY' THEN 'resource' WHEN 'HOUSEHOLD' THEN 'generated' END AS source_class,
       'page:' || CAST(c_nationkey AS STRING) AS page_id, c_mktsegment AS language, 'nation:' || CAST(c_nationkey AS STRING) AS home FROM {customer}
UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'module', s_name, 'first_party', 'page:' || CAST(s_nationkey AS STRING), 'supply', 'nation:' || CAST(s_nationkey AS STRING) FROM {supplier}
UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), 'concept', n_name, 'resource', 'page:' || CAST(n_nationkey AS STRING), NULL, 'region:' || CAST(n_regionkey AS STRING) FROM {nation}
UNION ALL SELECT 'region:' || CAST(r_regionkey AS STRING), 'entity', r_name, NULL, NULL, NULL, NULL FROM {region}
UNION ALL SELECT 'part:' || CAST(p_partkey AS STRING), 'symbol', p_name, NULL, NULL, p_type, NULL FROM {part}
"""
EDGES = """
SELECT 'e:c:' || CAST(c_custkey AS STRING) AS id, 'customer:' || CAST(c_custkey AS STRING) AS source, 'nation:' || CAST(c_nationkey AS STRING) AS target, 'mentions' AS relation,
       CASE WHEN c_acctbal < 0 THEN 'ambiguous' ELSE 'extracted' END AS evidence_class, LEAST(1.0, GREATEST(0.0, c_acctbal / 10000.0)) AS confidence FROM {customer}
UNION ALL SELECT 'e:s:' || CAST(s_suppkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), 'nation:' || CAST(s_nationkey AS STRING), 'mentions', 'extracted', LEAST(1.0, GREATEST(0.0, s_acctbal / 10000.0)) FROM {supplier}
UNION ALL SELECT 'e:n:' || CAST(n_nationkey AS STRING), 'region:' || CAST(n_regionkey AS STRING), 'nation:' || CAST(n_nationkey AS STRING), 'contains', 'extracted', 1.0 FROM {nation}
UNION ALL SELECT 'e:p:' || CAST(l_suppkey AS STRING) || ':' || CAST(l_partkey AS STRING), 'supplier:' || CAST(l_suppkey AS STRING), 'part:' || CAST(l_partkey AS STRING), 'defines', 'inferred', 0.9
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) d
UNION ALL SELECT 'e:i:' || CAST(a AS STRING) || ':' || CAST(b AS STRING), 'supplier:' || CAST(a AS STRING), 'supplier:' || CAST(b AS STRING), 'imports', 'extracted', 1.0
  FROM (SELECT DISTINCT a, b FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM {lineitem}) x WHERE a <> b) i
"""
TABLES = ("customer", "supplier", "nation", "region", "part", "lineitem")
#: For the oracle: WITH nodes AS (...), edges AS (...).
WITH = f"WITH RECURSIVE nodes AS MATERIALIZED ({NODES.format(**{t: t for t in TABLES})}), edges AS MATERIALIZED ({EDGES.format(**{t: t for t in TABLES})})"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of graph tables that this process has written: by session, source folder and state of its files.
_STORED: dict[tuple[str, str, str], tuple[DataFrame, DataFrame]] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Changes with any file of the tables: names, lengths and times."""
    said, conf = [], spark._jsc.hadoopConfiguration()
    for t in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        said += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in path.getFileSystem(conf).listStatus(path)]
    return hashlib.sha256("\n".join(sorted(said)).encode()).hexdigest()


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, written as tables by the first query that asks for it in a session and read by all later ones, as long as the files it comes from are the same."""
    at = spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir)
    if at not in _STORED:
        made = _made(spark, sf_dir)
        _STORED[at] = written(made.nodes, "nodes"), written(made.edges, "edges")
    return Graph(*_STORED[at])


def _made(spark: SparkSession, sf_dir: str) -> Graph:
    tables = {t: read(spark, sf_dir, t) for t in TABLES}
    used = lambda sql: {t: d for t, d in tables.items() if "{" + t + "}" in sql}
    nodes = spark.sql(NODES, **used(NODES)).withColumn("source_ids", F.when(F.col("home").isNull(), F.array().cast("array<string>")).otherwise(F.array("home")))
    edges = spark.sql(EDGES, **used(EDGES)).withColumn("confidence", F.col("confidence").cast("double"))
    return Graph(nodes, edges)


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
