"""Queries of the stored index, of trees and of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftgraph.operators import tree as TR
from weftgraph.operators import upkeep as U
from weftgraph.operators.segments import SegmentIndex
from weftgraph.plans.model import read
from weftgraph.plans.retrieval_queries import MANY, _asked
from weftgraph.session import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _earlier(docs):
    """What documents were before: those of src1 had other texts, those of src2 did not exist, and each other one had a draft beside it."""
    kept = docs.where("source is null or source <> 'src2'")
    drafts = kept.select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return kept.select("doc_id", F.when(F.col("source") == "src1", F.concat(F.lit("draft "), F.col("text"))).otherwise(F.col("text")).alias("text")).unionByName(drafts)


def _fresh(spark):
    return SegmentIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")


@query(f"WITH {MANY} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::BIGINT AS rank, doc_id, round(score, 6)::DOUBLE AS score FROM s QUALIFY rank <= 20")
def incremental_search(spark, d):
    """The search of ``bm25_search`` on an index that began as another corpus and came to this one by updates, removals and merges."""
    docs, asked = _asked(spark, d)
    index = _fresh(spark)
    index.refresh(_earlier(docs))
    index.update(docs.where("source = 'src1'"), docs.select((-F.col("doc_id") - 1).alias("doc_id")))
    index.merge(most=1)
    index.refresh(docs)
    index.merge(most=2)
    return index.search(asked, 20).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT count(*) FILTER (WHERE source = 'src1' AND text IS NOT NULL) AS changed, count(*) FILTER (WHERE source = 'src2') AS added, count(*) FILTER (WHERE source IS NULL OR source <> 'src2') AS before, count(*) AS n FROM documents)
SELECT 'begin' AS step, 2 * before AS added, 0::BIGINT AS changed, 0::BIGINT AS removed, 0::BIGINT AS kept FROM e UNION ALL SELECT 'refresh', added, changed, before, n - added - changed FROM e UNION ALL SELECT 'again', 0, 0, 0, n FROM e""")
def refresh_counts(spark, d):
    """What each refresh found: only added and changed pages are split in words."""
    docs, index = read(spark, d, "documents"), _fresh(spark)
    steps = [("begin", index.refresh(_earlier(docs))), ("refresh", index.refresh(docs)), ("again", index.refresh(docs))]
    return spark.createDataFrame([(name, *(c[x] for x in ("added", "changed", "removed", "kept"))) for name, c in steps], "step string, added long, changed long, removed long, kept long")


@query("SELECT * FROM (VALUES ('before', 'missing', 'rebuild'), ('changed', 'stale', 'refresh'), ('now', 'current', 'none')) v(moment, status, action) WHERE moment <> 'changed' OR EXISTS (SELECT 1 FROM documents)")
def index_state(spark, d):
    """The three states of an index against documents: before it is written, after documents changed, after a refresh."""
    docs, index = read(spark, d, "documents"), _fresh(spark)
    before = index.status(docs)
    index.refresh(_earlier(docs))
    changed = index.status(docs).withColumn("moment", F.lit("changed")).checkpoint()
    index.refresh(docs)
    return before.withColumn("moment", F.lit("before")).unionByName(changed).unionByName(index.status(docs).withColumn("moment", F.lit("now"))).select("moment", "status", "action")


@query("""WITH RECURSIVE s AS (SELECT 'c' || c_custkey::VARCHAR AS sid, c_custkey, r_name AS a, n_name AS b, c_mktsegment AS c, c_name AS label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
o AS (SELECT 'c' || o_custkey::VARCHAR AS sid, 'p' || o_custkey::VARCHAR || o_orderpriority AS module, o_orderpriority AS prio, 'o' || o_orderkey::VARCHAR AS id, o_orderstatus AS label FROM orders), m AS (SELECT sid, module, prio, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT 'tree:root/' || a AS id, 'tree:root' AS parent, 'directory' AS kind, 0 AS k, a AS label, count(*) AS n, NULL AS node_id FROM s GROUP BY a UNION ALL SELECT 'tree:root/' || a || '/' || b, 'tree:root/' || a, 'directory', 0, b, count(*), NULL FROM s GROUP BY a, b
UNION ALL SELECT 'tree:root/' || a || '/' || b || '/' || c, 'tree:root/' || a || '/' || b, 'directory', 0, c, count(*), NULL FROM s GROUP BY a, b, c UNION ALL SELECT 'tree:source:' || sid, 'tree:root/' || a || '/' || b || '/' || c, 'source', 1, label, coalesce((SELECT count(*) FROM m WHERE m.sid = s.sid), 0), NULL FROM s
UNION ALL SELECT 'tree:' || module, 'tree:source:' || sid, 'module', 2, prio, n, module FROM m JOIN s USING (sid) UNION ALL SELECT 'tree:' || o.id, 'tree:' || module, 'symbol', 3, o.label, 0, o.id FROM o JOIN s USING (sid)),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY k, label, id) AS rank, count(*) OVER (PARTITION BY parent) AS kids FROM t),
v AS (SELECT * FROM r WHERE parent = 'tree:root' AND rank <= 4 UNION ALL SELECT r.* FROM r JOIN v ON r.parent = v.id WHERE r.rank <= 4)
SELECT id, parent, kind, label, n::BIGINT AS count, node_id, rank::BIGINT AS rank FROM v UNION ALL SELECT DISTINCT parent || ':more', parent, 'more', '+' || (kids - 4)::VARCHAR || ' more', (kids - 4)::BIGINT, NULL, 5::BIGINT FROM v WHERE kids > 4""")
def graph_tree(spark, d):
    """Customers as sources in folders of region, nation and segment; their order priorities as modules, their orders as symbols; four children each."""
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    sources = read(spark, d, "customer").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name").alias("path"), F.col("c_name").alias("title"))
    cust = F.col("o_custkey").cast("string")
    o = read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("symbol").alias("type"), F.col("o_orderstatus").alias("label"), F.array(F.concat(F.lit("c"), cust)).alias("source_ids"), F.concat(F.lit("p"), cust, "o_orderpriority").alias("module_id"), "o_orderpriority")
    modules = o.select(F.col("module_id").alias("id"), F.lit("module").alias("type"), F.col("o_orderpriority").alias("label"), "source_ids", F.lit(None).cast("string").alias("module_id")).distinct()
    return TR.graph_tree(sources, modules.unionByName(o.drop("o_orderpriority")), 4).withColumn("rank", F.col("rank").cast("long"))


LINES = r"regexp_replace(coalesce(text, ''), '([.!?]) ', '\1' || chr(10), 'g')"
TRIMMED = lambda c: f"len(string_split(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), chr(10)))"


@query(f"""WITH d AS (SELECT doc_id, {LINES} AS t FROM documents), p AS (SELECT a.doc_id, a.t AS x, b.t AS y, {TRIMMED('b.t')} - {TRIMMED('a.t')} AS more FROM d a LEFT JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, (CASE WHEN y IS NULL THEN 0 ELSE len(string_split(y, chr(10))) END - len(string_split(x, chr(10))))::BIGINT AS balance, CASE WHEN y IS NULL THEN 'Removed page' WHEN more > 0 THEN 'added ' || more || ' line(s)' WHEN more < 0 THEN 'removed ' || -more || ' line(s)' WHEN x <> y THEN 'modified content' ELSE 'no visible changes' END AS summary FROM p""")
def line_changes(spark, d):
    """Each document against the next one, sentence by line."""
    lines = read(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "([.!?]) ", "$1\n").alias("before"))
    pairs = lines.join(lines.select((F.col("doc_id") - 1).alias("doc_id"), F.col("before").alias("after")), "doc_id", "left")
    return U.line_changes(pairs).select("doc_id", (F.col("added") - F.col("removed")).alias("balance"), "summary")
