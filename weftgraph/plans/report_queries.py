"""Queries of reports, upkeep, graph building, exports and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.scoring import lookup
from weftgraph.operators import analysis as A
from weftgraph.operators import build as B
from weftgraph.operators import export as E
from weftgraph.operators import graph as G
from weftgraph.operators import metrics as M
from weftgraph.operators import pack as P
from weftgraph.operators import reports as R
from weftgraph.operators import retrieval as S
from weftgraph.operators import upkeep as U
from weftgraph.plans import graph_queries as GQ
from weftgraph.plans import text_queries as TQ
from weftgraph.plans.model import WITH, graph, read
from weftgraph.plans.retrieval_queries import MANY, _asked, stored_index

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


NEAR = GQ.NEAR
BRIDGE = "hm AS (SELECT id, home FROM nodes WHERE home IS NOT NULL), seen AS (SELECT near.id, count(DISTINCT coalesce(o.home, s.home)) AS n FROM near LEFT JOIN hm o ON o.id = neighbor LEFT JOIN hm s ON s.id = near.id GROUP BY near.id), bridge AS (SELECT nodes.id, CASE WHEN type = 'source' THEN coalesce(n, 0) ELSE greatest(0, coalesce(n, 0) - 1) END AS bridge_score FROM nodes LEFT JOIN seen ON seen.id = nodes.id)"
GOD = "own AS (SELECT degree, row_number() OVER (ORDER BY degree DESC) - 1 AS i FROM degree WHERE type <> 'source'), cut AS (SELECT degree AS least FROM own WHERE i = (SELECT greatest(0, floor(count(*) * 0.1) - 1) FROM own)), god AS (SELECT id, degree FROM degree, cut WHERE type <> 'source' AND degree >= least AND degree > 0)"


def _measured(spark, d):
    """The graph, its adjacency, degrees with hubs, and bridge scores."""
    g = graph(spark, d)
    near = M.adjacency(g.nodes, g.edges)
    return g, M.god_nodes(M.degrees(g.nodes, near)), M.bridge_scores(g.nodes, near, GQ._homes(g))


@query(f"{WITH}, {NEAR}, {GOD} SELECT row_number() OVER (ORDER BY degree DESC, id)::BIGINT AS rank, id, degree::BIGINT AS degree FROM god QUALIFY rank <= 10")
def top_hubs(spark, d):
    return R.top_hubs(_measured(spark, d)[1]).select(F.col("rank").cast("long").alias("rank"), "id", "degree")


@query(f"""{WITH}, c AS (SELECT home AS id, home AS label, count(*) AS size FROM nodes WHERE home IS NOT NULL GROUP BY home HAVING count(*) < 64), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, label) AS k FROM c)
SELECT id, label, size::BIGINT AS nodes, 1::BIGINT AS communities FROM r WHERE k <= 6 UNION ALL SELECT NULL, (SELECT string_agg(label, ', ' ORDER BY k) FROM r WHERE k BETWEEN 7 AND 10), sum(size)::BIGINT, count(*)::BIGINT FROM r WHERE k > 6 HAVING count(*) > 0""")
def fragmented_communities(spark, d):
    sizes = GQ._homes(graph(spark, d)).groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("size")).withColumn("label", F.col("id"))
    return R.fragmented(sizes, 64)


@query(f"""{WITH}, {NEAR}, {BRIDGE}, {GOD}, q AS (
SELECT 1 AS part, row_number() OVER (ORDER BY home) AS k, 'What sources would strengthen community ' || home || '?' AS question FROM (SELECT home FROM nodes WHERE home IS NOT NULL GROUP BY home HAVING count(*) <= 2)
UNION ALL SELECT 2, row_number() OVER (ORDER BY bridge_score DESC, b.id) AS k, 'Why does ' || label || ' connect multiple communities in the vault?' FROM bridge b JOIN nodes USING (id) WHERE bridge_score > 0 QUALIFY k <= 3
UNION ALL SELECT 3, row_number() OVER (ORDER BY e.id) AS k, 'What is the exact relationship between ' || a.label || ' and ' || b.label || '?' FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.evidence_class = 'ambiguous' QUALIFY k <= 3
UNION ALL SELECT 4, row_number() OVER (ORDER BY g.id) AS k, 'Are the inferred relationships involving ' || label || ' correct?' FROM god g JOIN nodes USING (id) WHERE (SELECT count(*) FROM edges e WHERE e.evidence_class = 'inferred' AND (e.source = g.id OR e.target = g.id)) >= 2 QUALIFY k <= 8
UNION ALL SELECT 5, row_number() OVER (ORDER BY x.id) AS k, 'What connects ' || label || ' to the rest of the vault?' FROM degree x JOIN nodes USING (id) WHERE degree <= 1 AND x.type <> 'source' QUALIFY k <= 3)
SELECT row_number() OVER (ORDER BY spot)::BIGINT AS rank, question FROM (SELECT question, min((part, k)) AS spot FROM q GROUP BY question) QUALIFY rank <= 8""")
def suggested_questions(spark, d):
    g, degree, bridge = _measured(spark, d)
    nodes = g.nodes.select("id", "label").join(degree, "id").join(bridge, "id")
    sizes = GQ._homes(g).groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("size")).withColumn("label", F.col("id"))
    return R.suggested_questions(nodes, g.edges, sizes).select(F.col("rank").cast("long").alias("rank"), "question")


@query(f"""{WITH}, {NEAR}, m AS (SELECT degree.id, degree FROM degree JOIN nodes USING (id) WHERE home = 'nation:1'),
x AS (SELECT 'node' AS part, row_number() OVER (ORDER BY degree DESC, id) AS rank, id FROM m UNION ALL SELECT 'page', row_number() OVER (ORDER BY page_id), page_id FROM (SELECT DISTINCT page_id FROM nodes WHERE home = 'nation:1' AND page_id IS NOT NULL)
UNION ALL SELECT 'edge', row_number() OVER (ORDER BY id), id FROM edges WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)) SELECT part, rank::BIGINT AS rank, id FROM x WHERE rank <= 50""")
def community_view(spark, d):
    g = graph(spark, d)
    return R.community_view(g.nodes.select("id", "type", F.col("home").alias("community_id"), "page_id"), g.edges, "nation:1").withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT board, rank::BIGINT AS rank, id FROM (SELECT 'timeline' AS board, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank, o_orderkey AS id, 25 AS most FROM orders UNION ALL SELECT 'recent', row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey), o_orderkey, 20 FROM orders
UNION ALL SELECT 'research', row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey), o_orderkey, 8 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') WHERE rank <= most""")
def dashboards(spark, d):
    pages = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "output").otherwise("source").alias("kind"), F.when(F.col("o_orderstatus") == "F", "archived").otherwise("active").alias("status"), F.col("o_orderdate").alias("occurred_at"), F.col("o_orderdate").alias("updated_at"))
    return R.dashboards(pages).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH w AS (SELECT source AS class, sum(len(string_split_regex(trim(text), '\\s+'))) AS w FROM documents GROUP BY 1), q AS (SELECT 'src' || (item_id % 3)::VARCHAR AS class, greatest(1, ceil(length(text) / 4.0)) AS t FROM benchmark), a AS (SELECT class, greatest(1, round(avg(t)))::BIGINT AS context_tokens FROM q GROUP BY class),
c AS (SELECT class, CASE WHEN w > 0 THEN greatest(1, round(w * 100 / 75)) ELSE 0 END::BIGINT AS corpus_tokens FROM w)
SELECT class, corpus_tokens, coalesce(context_tokens, 0)::BIGINT AS context_tokens, CASE WHEN coalesce(context_tokens, 0) > 0 AND corpus_tokens > 0 THEN round(1 - context_tokens / corpus_tokens, 3) ELSE 0 END::DOUBLE AS reduction FROM c LEFT JOIN a USING (class)""")
def token_reduction(spark, d):
    words = read(spark, d, "documents").select(F.col("source").alias("class"), F.size(F.split(F.trim("text"), r"\s+")).alias("words"))
    asked = read(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 3).cast("string")).alias("class"), T.estimate_context_tokens(F.col("text")).alias("tokens"))
    return R.token_reduction(words, asked)


@query(f"""{WITH}, {NEAR}, {GOD}, {BRIDGE} SELECT 'overview' AS part, 1::BIGINT AS rank, 'nodes' AS label, count(*)::BIGINT AS value FROM nodes UNION ALL SELECT 'overview', 1, 'edges', count(*) FROM edges
UNION ALL SELECT 'hub', row_number() OVER (ORDER BY degree DESC, id) AS rank, label, degree FROM god JOIN nodes USING (id) QUALIFY rank <= 5 UNION ALL SELECT 'bridge', row_number() OVER (ORDER BY bridge_score DESC, id) AS rank, label, bridge_score FROM bridge JOIN nodes USING (id) WHERE bridge_score > 0 QUALIFY rank <= 3""")
def graph_share(spark, d):
    g, degree, bridge = _measured(spark, d)
    return R.share(g.nodes, g.edges, degree, bridge).select("part", F.col("rank").cast("long").alias("rank"), "label", F.col("value").cast("long").alias("value"))


PAGES = """p AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'source' ELSE 'insight' END AS kind, CASE o_orderpriority WHEN '1-URGENT' THEN 'working' WHEN '2-HIGH' THEN 'episodic' WHEN '3-MEDIUM' THEN 'semantic' END AS tier, o_orderdate::TIMESTAMP AS updated_at, CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1 END AS superseded_by, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey + 1 END AS below FROM orders)"""
TIERS = """SELECT 'stale_working_tier' AS code, id::VARCHAR AS item FROM p WHERE kind = 'insight' AND coalesce(tier, 'working') = 'working' AND superseded_by IS NULL AND updated_at < TIMESTAMP '1998-07-01' - INTERVAL 48 HOUR
UNION ALL SELECT 'broken_consolidation_basis', id::VARCHAR FROM p WHERE kind = 'insight' AND tier IN ('episodic', 'semantic') AND below IS NOT NULL AND below NOT IN (SELECT id FROM p) UNION ALL SELECT 'semantic_without_episodic_basis', id::VARCHAR FROM p WHERE kind = 'insight' AND tier = 'semantic' AND below IS NULL"""


def _tiers(spark, d):
    o, none = read(spark, d, "orders"), F.array().cast("array<bigint>")
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "5-LOW", "source").otherwise("insight").alias("kind"), lookup(F.col("o_orderpriority"), {"1-URGENT": "working", "2-HIGH": "episodic", "3-MEDIUM": "semantic"}).alias("tier"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") + 1).alias("superseded_by"), F.when(F.col("o_custkey") % 3 == 0, F.array((F.col("o_orderkey") + 1).cast("long"))).otherwise(none).alias("from_ids"),
    )


@query(f"WITH {PAGES} {TIERS}")
def tier_findings(spark, d):
    return U.tier_lint(_tiers(spark, d), F.lit("1998-07-01 00:00:00").cast("timestamp"))


@query(f"""WITH {PAGES}, t AS ({TIERS}), x AS (SELECT code, item, CASE WHEN code = 'stale_working_tier' THEN 'info' ELSE 'warning' END AS severity FROM t UNION ALL SELECT 'broken_supersession', id::VARCHAR, 'error' FROM p WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM p)
UNION ALL SELECT 'inconsistent_decay', id::VARCHAR, 'warning' FROM p WHERE superseded_by IS NOT NULL UNION ALL SELECT 'orphan_page', id::VARCHAR, 'info' FROM p WHERE kind <> 'source' AND below IS NULL UNION ALL SELECT 'stale_page', id::VARCHAR, 'warning' FROM p WHERE id % 5 = 0 UNION ALL SELECT 'contradiction', doc_id::VARCHAR, 'warning' FROM labels WHERE toxic = 1) SELECT * FROM x""")
def lint_findings(spark, d):
    pages = _tiers(spark, d).withColumns({"freshness": F.lit("fresh"), "decay_score": F.lit(1.0), "backlinks": F.col("from_ids"), "source_hashes": F.create_map(F.col("id"), F.when(F.col("id") % 5 == 0, "old").otherwise("same"))})
    edges = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("contradicts").alias("relation"))
    return U.lint(pages, pages.select(F.col("id").alias("source_id"), F.lit("same").alias("hash")), edges, F.lit("1998-07-01 00:00:00").cast("timestamp"))


@query("SELECT CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'error' ELSE 'ok' END AS status, (count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT AS ok, (count(*) FILTER (WHERE o_orderstatus = 'O'))::BIGINT AS warning, (count(*) FILTER (WHERE o_orderstatus = 'P'))::BIGINT AS error FROM orders")
def doctor_status(spark, d):
    return U.doctor(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), lookup(F.col("o_orderstatus"), {"F": "ok", "O": "warning", "P": "error"}).alias("status")))


@query("SELECT o_custkey AS approval_id, count(*)::BIGINT AS entries, (count(*) FILTER (WHERE s = 'pending'))::BIGINT AS pending, (count(*) FILTER (WHERE s = 'accepted'))::BIGINT AS accepted, (count(*) FILTER (WHERE s = 'rejected'))::BIGINT AS rejected FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderpriority = '1-URGENT' THEN 'rejected' ELSE 'pending' END AS s FROM orders) GROUP BY 1")
def approval_summary(spark, d):
    entries = read(spark, d, "orders").select(F.col("o_custkey").alias("approval_id"), F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("pending").alias("status"), "o_orderpriority")
    return U.approval_summary(U.decide_entries(entries, entries.where("o_orderpriority = '1-URGENT'"), "rejected"))


PROMOTED = """c AS (SELECT o_custkey AS id, list_distinct(list(o_orderpriority)) AS now, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F')) AS before, count(*) AS degree, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END), 6) AS confidence, datediff('day', max(o_orderdate), TIMESTAMP '1998-12-31 00:00:00') * 24.0 AS age FROM orders GROUP BY o_custkey),
g AS (SELECT id, (len(now) >= 3)::INT + (confidence >= 0.8)::INT + (CASE WHEN before IS NULL OR len(before) = 0 THEN 0 ELSE len(list_intersect(now, before)) / len(list_distinct(list_concat(now, before))) END >= 0.7)::INT + (degree >= 2)::INT + (age >= 24)::INT AS passed FROM c)"""


def _candidates(spark, d):
    done = F.col("o_orderstatus") == "F"
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.collect_set("o_orderpriority").alias("source_ids"), F.collect_set(F.when(done, F.col("o_orderpriority"))).alias("previous_ids"), F.count("*").alias("degree"),
        F.round(F.avg(F.when(done, 1.0).otherwise(0.5)), 6).alias("confidence"), (F.date_diff(F.lit("1998-12-31"), F.max("o_orderdate")) * 24.0).alias("age_hours"),
    )


@query(f"WITH {PROMOTED} SELECT id, passed / 5.0::DOUBLE AS score, CASE WHEN passed = 5 AND row_number() OVER (ORDER BY passed DESC, id) <= 25 THEN 'promote' ELSE 'keep' END AS action FROM g")
def promotion_run(spark, d):
    return U.promotion_run(_candidates(spark, d))


@query("""WITH c AS (SELECT o_custkey AS id, list_distinct(list(o_orderpriority)) AS now, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F')) AS before FROM orders GROUP BY 1)
SELECT id, CASE WHEN before IS NOT NULL AND len(before) > 0 AND len(list_intersect(now, before)) / len(list_distinct(list_concat(now, before))) >= 0.5 THEN 'active' ELSE 'candidate' END AS status FROM c""")
def candidate_states(spark, d):
    c = _candidates(spark, d)
    return U.candidate_status(c.select("id", "source_ids"), c.where(F.size("previous_ids") > 0).select("id", F.col("previous_ids").alias("source_ids")))


@query("""SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (WHERE value >= 50)::BIGINT AS notes, count(*) FILTER (WHERE value < 50)::BIGINT AS decisions, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY user_id""")
def task_ledger(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("task_id"), F.struct("ts", "event_id").alias("seq"), F.col("ts").alias("at"), F.when(F.col("value") >= 50, "note").otherwise("decision").alias("kind"), F.col("event_id").cast("string").alias("text"), F.col("event_type").alias("status"))
    return U.tasks_of_events(e).select("task_id", "status", F.size("notes").cast("long").alias("notes"), F.size("decisions").cast("long").alias("decisions"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS k, 'part:' || l_partkey::VARCHAR AS part FROM lineitem), t AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders)
SELECT 'memory:' || id || '->part:' || k || ':uses' AS id, 0.9::DOUBLE AS confidence FROM (SELECT id::VARCHAR AS id, row_number() OVER (PARTITION BY id ORDER BY k) AS k FROM l)
UNION ALL SELECT 'memory:' || id || '->part:' || k || ':produced', 0.68 FROM (SELECT id::VARCHAR AS id, row_number() OVER (PARTITION BY id ORDER BY k) AS k FROM l WHERE id IN (SELECT id FROM t WHERE s = 'F')) WHERE k <= 12
UNION ALL SELECT 'memory:' || id::VARCHAR || '->decision:1:records', 1.0 FROM t UNION ALL SELECT 'memory:' || id::VARCHAR || '->decision:follow-up-1:follows', 0.82 FROM t WHERE s = 'O'""")
def task_graph(spark, d):
    parts = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("part:"), x["l_partkey"].cast("string"))).alias("node_ids"))
    none = F.array().cast("array<string>")
    tasks = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("active").alias("status"), F.array(F.col("o_orderpriority")).alias("decisions"), F.when(F.col("o_orderstatus") == "F", "done").alias("outcome"), F.when(F.col("o_orderstatus") == "O", F.array(F.lit("look again"))).otherwise(none).alias("follow_ups"), none.alias("changed_paths")).join(parts, "id", "left").withColumn("node_ids", F.coalesce("node_ids", none))
    edges = U.task_graph(tasks)[1]
    n, kind = F.regexp_extract("id", r":(\d+)$", 1), lookup(F.col("relation"), {"uses_context": "uses", "produced_output": "produced", "records_decision": "records", "follows_up": "follows"})
    target = F.when(F.col("relation").isin("uses_context", "produced_output"), F.concat(F.lit("part:"), n)).otherwise(F.concat(F.lit("decision:"), F.regexp_extract("target", r"([^:]+)$", 1)))
    return edges.select(F.concat("source", F.lit("->"), target, F.lit(":"), kind).alias("id"), "confidence")


TERMS, CLAIMS, POLARITY, SLUG = TQ.TERMS, TQ.CLAIMS, TQ.POLARITY, TQ.SLUG


@query(f"""WITH t AS MATERIALIZED {TERMS}, c AS MATERIALIZED (SELECT *, {POLARITY} AS polarity FROM {CLAIMS}), polar AS (SELECT t.term AS concept, c.doc_id, c.nth, c.polarity FROM t JOIN c ON c.doc_id = t.doc_id WHERE contains(lower(c.claim), t.term)),
w AS (SELECT doc_id, polarity, list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z][a-z0-9-]{{2,}}')), lambda x: x NOT IN ({TQ.strings(T.CLAIM_STOPWORDS)})) AS w FROM c WHERE polarity <> 'neutral'),
e AS (SELECT 'source:' || doc_id || '->concept:' || {SLUG('term')} || ':mentions' AS id, 'extracted' AS evidence_class, CASE WHEN count(*) > 0 THEN 0 END AS z FROM t GROUP BY 1
UNION SELECT 'source:' || least(p.doc_id, n.doc_id) || '->source:' || greatest(p.doc_id, n.doc_id) || ':conflicted_with', 'ambiguous', 0 FROM polar p JOIN polar n ON p.concept = n.concept AND p.doc_id <> n.doc_id WHERE p.polarity = 'positive' AND n.polarity = 'negative'
UNION SELECT 'source:' || least(a.doc_id, b.doc_id) || '->source:' || greatest(a.doc_id, b.doc_id) || ':contradicts', 'ambiguous', 0 FROM w a JOIN w b ON a.doc_id <> b.doc_id AND a.polarity = 'positive' AND b.polarity = 'negative' WHERE len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.3)
SELECT 'edge' AS part, id, evidence_class AS kind FROM e UNION ALL SELECT DISTINCT 'node', 'concept:' || {SLUG('term')}, 'concept' FROM t UNION ALL SELECT 'node', 'source:' || doc_id, 'source' FROM documents""")
def document_graph(spark, d):
    g = B.document_graph(read(spark, d, "documents"))
    return g.edges.select(F.lit("edge").alias("part"), "id", F.col("evidence_class").alias("kind")).unionByName(g.nodes.select(F.lit("node").alias("part"), "id", F.col("type").alias("kind")))


@query(f"""{WITH}, h AS (SELECT target AS hub FROM edges WHERE relation = 'mentions' AND source LIKE 'customer:%' GROUP BY target HAVING count(DISTINCT source) >= 3), x AS (SELECT 'node' AS kind, id AS item_id, concat_ws(chr(10), label, type) AS text FROM nodes UNION ALL SELECT 'page', page_id::VARCHAR, url FROM pages UNION ALL SELECT 'hyperedge', hub, hub FROM h)
SELECT kind, item_id, sha256(text) AS content_hash FROM x WHERE trim(text) <> ''""")
def embeddable_items(spark, d):
    g = graph(spark, d)
    hyper = G.topic_hyperedges(g.nodes, g.edges).select(F.col("hub").alias("id"), F.col("hub").alias("label"), F.lit(None).cast("string").alias("why"))
    pages = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), F.lit(None).cast("string").alias("body"))
    return B.embeddable_items(g.nodes.withColumn("description", F.lit(None).cast("string")), pages, hyper).select("kind", "item_id", "content_hash")


@query("""WITH b AS (SELECT doc_id, 1 AS was, quality AS v FROM (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id)), a AS (SELECT doc_id, 1 AS now, n_chars % 2 AS v FROM documents), c AS (SELECT CASE WHEN was IS NULL THEN 'created' WHEN now IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'updated' END AS change FROM a FULL JOIN b USING (doc_id))
SELECT (count(*) FILTER (WHERE change <> 'removed'))::BIGINT AS scanned, (count(*) FILTER (WHERE change = 'created'))::BIGINT AS imported, (count(*) FILTER (WHERE change = 'updated'))::BIGINT AS updated, (count(*) FILTER (WHERE change = 'removed'))::BIGINT AS removed, (count(*) FILTER (WHERE change = 'unchanged'))::BIGINT AS skipped FROM c""")
def sync_counts(spark, d):
    before = read(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").cast("long").alias("v"))
    return B.sync_counts(G.changes(before, read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("long").alias("v")), "doc_id", "v"))


@query("SELECT d.doc_id AS source_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.n_chars % 2 <> l.quality THEN 'content' ELSE 'schema' END AS reason FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id) WHERE l.doc_id IS NULL OR d.n_chars % 2 <> l.quality OR l.toxic = 1")
def dirty_sources(spark, d):
    before = read(spark, d, "labels").groupBy(F.col("doc_id").alias("source_id")).agg(F.min("quality").cast("long").alias("content_hash"), F.max("toxic").alias("schema_hash"))
    return B.dirty_sources(read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), (F.col("n_chars") % 2).cast("long").alias("content_hash"), F.lit(0).alias("schema_hash")), before)


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(substr(text, 1, 80))), '\\s+', ' ', 'g')) AS label FROM documents")
def normalized_labels(spark, d):
    return read(spark, d, "documents").select("doc_id", T.norm_label(F.substring("text", 1, 80)).alias("label"))


XML = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"""{WITH} SELECT 'node' AS part, id, '<node id="' || {XML('id')} || '"><data key="label">' || {XML('label')} || '</data><data key="type">' || type || '</data></node>' AS line FROM nodes
UNION ALL SELECT 'edge', id, '<edge id="' || {XML('id')} || '" source="' || source || '" target="' || target || '"><data key="relation">' || relation || '</data><data key="evidence">' || evidence_class || '</data></edge>' FROM edges""")
def graphml_export(spark, d):
    g = graph(spark, d)
    return E.graphml_lines(g.nodes, g.edges)


@query(f"""{WITH} SELECT 'node' AS part, id, 'MERGE (n:Node {{{{id: ''' || id || '''}}}}) SET n.label = ''' || label || ''', n.type = ''' || type || ''';' AS line FROM nodes
UNION ALL SELECT 'edge', id, 'MATCH (a:Node {{{{id: ''' || source || '''}}}}), (b:Node {{{{id: ''' || target || '''}}}}) MERGE (a)-[r:' || upper(relation) || ' {{{{id: ''' || id || '''}}}}]->(b);' FROM edges""".replace("{{", "{").replace("}}", "}"))
def cypher_export(spark, d):
    g = graph(spark, d)
    return E.cypher_lines(g.nodes, g.edges)


@query("SELECT page_id AS id, '{\"@context\":\"https://schema.org\",\"@type\":\"Article\",\"name\":\"page ' || page_id || '\",\"url\":\"' || url || '\"}' AS json_ld FROM pages")
def json_ld_export(spark, d):
    return E.page_json_ld(read(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), "url"))


NORMAL = TQ.NORMAL


@query(f"""WITH {MANY}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 5), x AS (SELECT doc_id, {NORMAL} AS t FROM documents)
SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS related, sha256(string_agg('- ' || CASE WHEN length(t) <= 1200 THEN t ELSE substr(t, 1, 1197) || '...' END, chr(10) ORDER BY rank)) AS answer FROM r JOIN x USING (doc_id) GROUP BY query_id""")
def question_answers(spark, d):
    docs, asked = _asked(spark, d)
    quoted = S.excerpts(stored_index(spark, d).search(asked), docs)
    return S.answers(quoted, asked).select("query_id", F.array_join("related", ",").alias("related"), F.sha2("answer", 256).alias("answer"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS cust FROM orders), l AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS part, l_suppkey AS supp FROM lineitem), t AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
x AS (SELECT t.id AS target, o.id AS output, 3 AS rank FROM t JOIN o ON o.cust = t.id UNION ALL SELECT t.id, l.id, 2 FROM t JOIN l ON l.part = t.id UNION ALL SELECT t.id, l.id, 1 FROM t JOIN l ON l.supp = t.id) SELECT target, output, max(rank)::BIGINT AS rank FROM x GROUP BY ALL""")
def related_outputs(spark, d):
    none = F.lit(None).cast("array<long>")
    key = lambda c: F.array(F.col(c).cast("long"))
    # An output's keys come in several rows: nothing is gathered by order first.
    pages = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), key("o_custkey").alias("related_page_ids"), none.alias("related_node_ids"), none.alias("related_source_ids"))
    outputs = pages.unionByName(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), none.alias("related_page_ids"), key("l_partkey").alias("related_node_ids"), key("l_suppkey").alias("related_source_ids")))
    targets = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.array("c_custkey").alias("node_ids"), F.array("c_custkey").alias("source_ids"))
    return S.related_outputs(targets, outputs).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT o_orderkey AS id, max(CASE r WHEN 'page' THEN 100 - least(k, 99) WHEN 'node' THEN 76 - least(k, 30) ELSE 70 - least(k, 25) END)::DOUBLE AS score FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'page' WHEN 'O' THEN 'node' ELSE 'edge' END AS r, l_linenumber * 9 AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1""")
def pack_candidates(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    items = rows.select(F.col("o_orderkey").alias("id"), lookup(F.col("o_orderstatus"), {"F": "page", "O": "node"}, "edge").alias("role"), (F.col("l_linenumber") * 9).alias("place"), F.lit("t").alias("title"), F.lit(1).alias("tokens"))
    return P.candidates(items).select("id", "score")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 126 WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 108 ELSE 116 END WHEN o_orderpriority = '2-HIGH' THEN 96 WHEN o_orderstatus = 'O' THEN 90 ELSE 82 END::BIGINT AS score FROM orders WHERE o_orderkey = 7 OR o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'O' OR o_custkey % 2 = 0")
def task_scores(spark, d):
    none = F.array().cast("array<string>")
    o = read(spark, d, "orders")
    tasks = o.select(
        F.col("o_orderkey").alias("id"), F.lit("Task").alias("title"), F.col("o_orderpriority").alias("goal"), F.when(F.col("o_orderpriority") == "1-URGENT", "src/urgent.py").alias("target"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("active").alias("status"),
        F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("yes"))).otherwise(none).alias("decisions"), F.when(F.col("o_orderstatus") == "O", F.array(F.lit("later"))).otherwise(none).alias("follow_ups"), none.alias("changed_paths"),
    )
    return P.task_score(tasks, "urgent.py", "2-high", 7).select("id", F.col("score").cast("long").alias("score"))
