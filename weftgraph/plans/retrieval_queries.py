"""Queries of retrieval, lifecycle, packing, sources and streams."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from weftgraph.functions import scoring as S
from weftgraph.functions import text as T
from weftgraph.operators import analysis as A
from weftgraph.operators import graph as G
from weftgraph.operators import lifecycle as L
from weftgraph.operators import pack as P
from weftgraph.operators import retrieval as R
from weftgraph.operators.segments import SegmentIndex
from weftgraph.plans.model import read
from weftgraph.session import shared_dir, with_checkpoints
from weftgraph.sources import files as SF
from weftgraph.sources import messages as SM
from weftgraph.sources import structured as SS
from weftgraph.streaming import refresh as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TOKEN = "'[a-z0-9][a-z0-9-]{1,}'"
NOW = "2024-02-01 00:00:00"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


MANY = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TOKEN})) AS term FROM documents), l AS (SELECT doc_id, len(regexp_extract_all(lower(text), {TOKEN})) AS dl FROM documents), co AS (SELECT count(*) AS n, avg(dl) AS mean FROM l), p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT doc_id AS query_id, term FROM p WHERE doc_id % 100 = 0), s AS (SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM q JOIN p USING (term) JOIN df USING (term) JOIN l ON l.doc_id = p.doc_id, co GROUP BY ALL)"""
NEAREST = "WITH n AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"


def _asked(spark, d):
    docs = read(spark, d, "documents")
    return docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def stored_index(spark, d):
    """The session's stored index of documents: the first search writes it, later ones compare hashes and read it."""
    index = SegmentIndex(spark, f"{shared_dir(spark)}/documents-{spark.sparkContext.applicationId}-{zlib.crc32(d.encode()):08x}")
    index.refresh(read(spark, d, "documents"))
    return index


@query(f"WITH {MANY} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::BIGINT AS rank, doc_id, round(score, 6)::DOUBLE AS score FROM s QUALIFY rank <= 20")
def bm25_search(spark, d):
    """Every document whose id is divisible by 100, as a question to all documents."""
    return stored_index(spark, d).search(_asked(spark, d)[1], 20).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {MANY} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::BIGINT AS rank, doc_id, round(score, 6)::DOUBLE AS score FROM s JOIN documents USING (doc_id) WHERE lang = 'en' AND source = 'src1' QUALIFY rank <= 5")
def filtered_search(spark, d):
    docs, asked = _asked(spark, d)
    return stored_index(spark, d).search(asked, 5, among=docs.where((F.col("lang") == "en") & (F.col("source") == "src1"))).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TOKEN})) AS term FROM documents) GROUP BY ALL")
def inverted_index(spark, d):
    return R.build_index(read(spark, d, "documents"))[0].select("doc_id", "term", "tf")


def _vectors(spark, d):
    rows = read(spark, d, "embeddings")
    return rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"{NEAREST} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id)::BIGINT AS rank, vec_id, round(c, 6)::DOUBLE AS score FROM n WHERE c >= 0.25 QUALIFY rank <= 10")
def semantic_search(spark, d):
    return R.semantic_many(*_vectors(spark, d), limit=10).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query(f"{NEAREST} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id)::BIGINT AS rank, vec_id, round(100 * c, 2)::DOUBLE AS score FROM n WHERE c >= 0.17995 QUALIFY rank <= 8")
def semantic_graph_matches(spark, d):
    return R.semantic_many(*_vectors(spark, d), least=0.17995, limit=8).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round(100 * F.col("score"), 2).alias("score"))


@query(f"""{NEAREST}, {MANY}, a AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 15), b AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM n WHERE c >= 0.25 QUALIFY rank <= 15)
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9)::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def hybrid_search(spark, d):
    words = stored_index(spark, d).search(_asked(spark, d)[1], 15).withColumnRenamed("doc_id", "id")
    near = R.semantic_many(*_vectors(spark, d), limit=15).withColumnRenamed("vec_id", "id")
    return R.fuse_many([words, near], "id").withColumn("score", F.round("score", 9))


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT a, b, round(c, 3)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM p WHERE c >= 0.35) WHERE rn <= 3""")
def embedding_edges(spark, d):
    """With a threshold under the default of 0.82, which no two of these vectors reach."""
    return R.embedding_edges(read(spark, d, "embeddings"), least=0.35)


CLASS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'first_party' WHEN '2-HIGH' THEN 'third_party' WHEN '3-MEDIUM' THEN 'resource' WHEN '5-LOW' THEN 'generated' END"
AGE = "(epoch_us(TIMESTAMP '1998-12-31 00:00:00') - epoch_us(o_orderdate::TIMESTAMP)) / 86400e6"


def _pages(spark, d):
    orders = read(spark, d, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), S.lookup(F.col("o_orderpriority"), {"1-URGENT": "first_party", "2-HIGH": "third_party", "3-MEDIUM": "resource", "5-LOW": "generated"}).alias("source_class"), F.col("o_orderdate").cast("timestamp").alias("confirmed_at"), F.when(F.col("o_orderstatus") == "P", F.lit("x")).alias("superseded_by"), F.lit("fresh").alias("freshness"))


@query(f"""WITH s AS (SELECT o_orderkey AS id, o_orderstatus, CASE WHEN {AGE} <= 0 THEN 1.0 ELSE pow(0.5, {AGE} / CASE {CLASS} WHEN 'first_party' THEN 365.0 WHEN 'third_party' THEN 90.0 WHEN 'resource' THEN 730.0 WHEN 'generated' THEN 30.0 ELSE 365.0 END) END AS score FROM orders)
SELECT id, round(score, 6)::DOUBLE AS decay_score, CASE WHEN o_orderstatus = 'P' OR score < 0.3 THEN 'stale' ELSE 'fresh' END AS freshness, (o_orderstatus = 'P' OR score < 0.3) AS newly_stale FROM s""")
def decayed_pages(spark, d):
    aged = L.apply_decay(_pages(spark, d), F.lit("1998-12-31 00:00:00").cast("timestamp"))
    return aged.select("id", F.round("decay_score", 6).alias("decay_score"), "freshness", "newly_stale")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' OR nxt IS NOT NULL THEN 'stale' ELSE 'fresh' END AS freshness, nxt::VARCHAR AS superseded_by, CASE WHEN nxt IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS decay_score FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)")
def superseded_pages(spark, d):
    from pyspark.sql.window import Window

    orders = read(spark, d, "orders")
    pairs = orders.select(F.col("o_orderkey").alias("old"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("string").alias("new")).where("new is not null")
    pages = _pages(spark, d).withColumn("decay_score", F.lit(1.0)).withColumn("freshness", F.when(F.col("superseded_by").isNotNull(), "stale").otherwise("fresh")).withColumn("superseded_by", F.lit(None).cast("string"))
    return L.supersede(pages, pairs).select("id", "freshness", "superseded_by", "decay_score")


@query("""SELECT 'part:' || l_partkey::VARCHAR AS node_id, count(DISTINCT o_orderkey)::BIGINT AS episodes, round(least(1.0, 0.5 + 0.1 * count(DISTINCT o_orderkey)), 6)::DOUBLE AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL 90 DAY GROUP BY l_partkey HAVING count(DISTINCT o_orderkey) >= 3""")
def recurring_nodes(spark, d):
    items = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("node_ids"))
    episodic = read(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), "node_ids")
    return L.recurring_nodes(episodic, F.lit("1998-08-01 00:00:00").cast("timestamp"))


@query("""WITH c AS (SELECT o_custkey AS id, list_distinct(list(o_orderpriority)) AS now, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F')) AS before, count(*) AS degree, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END), 6) AS confidence, datediff('day', max(o_orderdate), TIMESTAMP '1998-12-31 00:00:00') * 24.0 AS age FROM orders GROUP BY o_custkey),
g AS (SELECT id, (len(now) >= 3)::INT + (confidence >= 0.8)::INT + (CASE WHEN before IS NULL OR len(before) = 0 THEN 0 ELSE len(list_intersect(now, before)) / len(list_distinct(list_concat(now, before))) END >= 0.7)::INT + (degree >= 2)::INT + (age >= 24)::INT AS passed FROM c)
SELECT id, passed::BIGINT AS passed, passed / 5.0::DOUBLE AS score, passed = 5 AS promote FROM g""")
def promotion_gates(spark, d):
    done = F.col("o_orderstatus") == "F"
    c = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.collect_set("o_orderpriority").alias("source_ids"), F.collect_set(F.when(done, F.col("o_orderpriority"))).alias("previous_ids"), F.count("*").alias("degree"),
        F.round(F.avg(F.when(done, 1.0).otherwise(0.5)), 6).alias("confidence"), (F.date_diff(F.lit("1998-12-31"), F.max("o_orderdate")) * 24.0).alias("age_hours"),
    )
    return L.promotion(c, limit=None).withColumn("passed", F.col("passed").cast("long"))


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(*)::BIGINT AS n, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT + 1800000000 AS span_us FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.sessions(events).select("user_id", "n", (F.unix_micros("end") - F.unix_micros("start")).alias("span_us"))


@query()
def working_groups(spark, d):
    """Events of a user in growing groups by time and shared marks; a test holds it against a plain loop."""
    events = read(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.array(F.col("event_type"), F.concat(F.lit("v"), F.floor("value").cast("string"))).alias("marks"))
    return L.episodes(L.group_sessions(events, "user_id"), "user_id").select("user_id", "stretch", "group_no", "pages", "confidence")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2")
def daily_windows(spark, d):
    return X.window_counts(read(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("SELECT user_id::VARCHAR AS path, event_type AS reason FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS rn FROM events) WHERE rn = 1")
def pending_changes(spark, d):
    events = read(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("at"), F.col("event_type").alias("reason"))
    return X.latest_pending(None, events).select("path", "reason")


@query("SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'stale' ELSE 'fresh' END AS freshness FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def stale_pages(spark, d):
    pages = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("doc_id").alias("source_ids"), F.lit("fresh").alias("freshness"))
    return X.stale_pages(pages, read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_id"))).select("id", "freshness")


@query("SELECT CASE WHEN l.quality IS NULL THEN 'miss' ELSE 'hit' END AS found, d.doc_id AS item_id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 1 AS quality FROM labels) l USING (doc_id)")
def embedding_cache(spark, d):
    items = read(spark, d, "documents").select(F.lit("page").alias("kind"), F.col("doc_id").alias("item_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"))
    cache = read(spark, d, "labels").select("doc_id").distinct().select(F.lit("page").alias("kind"), F.col("doc_id").alias("item_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"))
    hit, miss = R.cached_embeddings(items, cache)
    return hit.select(F.lit("hit").alias("found"), "item_id").unionByName(miss.select(F.lit("miss").alias("found"), "item_id"))


@query("""WITH RECURSIVE i AS (SELECT doc_id, source, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, 100 - least(doc_id % 120, 99) AS score FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id::VARCHAR, doc_id) AS k FROM i),
f AS (SELECT source, doc_id, k, CASE WHEN tokens <= 4000 THEN tokens ELSE 0 END AS used, tokens <= 4000 AS included FROM r WHERE k = 1 UNION ALL SELECT r.source, r.doc_id, r.k, f.used + CASE WHEN f.used + r.tokens <= 4000 THEN r.tokens ELSE 0 END, f.used + r.tokens <= 4000 FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1)
SELECT source, count(*) FILTER (WHERE included)::BIGINT AS taken, coalesce(sum(doc_id) FILTER (WHERE included), 0)::BIGINT AS ids FROM f GROUP BY source""")
def context_packs(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", T.estimate_context_tokens(F.col("text")).alias("tokens"), P.role_score(F.lit("page"), F.col("doc_id") % 120).alias("score"), F.col("doc_id").cast("string").alias("title"))
    packed = P.fit(docs, 4_000, group="source")
    return packed.groupBy("source").agg(F.count_if("included").alias("taken"), F.coalesce(F.sum(F.when(F.col("included"), F.col("id"))), F.lit(0)).alias("ids"))


@query("WITH s AS (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT doc_id AS id, length(substr(text, 1, (5000000 - before)::BIGINT))::BIGINT AS n, sha256(substr(text, 1, (5000000 - before)::BIGINT)) AS content FROM s WHERE before < 5000000")
def full_text_export(spark, d):
    with_checkpoints(spark)
    pages = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.format_string("%012d", "doc_id").alias("path"), "text")
    return P.full_text(pages, 5_000_000).select("id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("content"))


@query("SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def page_links(spark, d):
    return SS.links(read(spark, d, "pages"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", SS.page_title(F.col("html")).alias("title"))


@query()
def page_markdown(spark, d):
    return SS.markdown_of_pages(read(spark, d, "pages"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS part_index, count(*) OVER (PARTITION BY conv_id)::BIGINT AS part_count FROM conversations")
def conversation_parts(spark, d):
    return SF.parts(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("part_index").cast("long").alias("part_index"), "part_count")


@query("SELECT 'c' || (conv_id % 20)::VARCHAR AS channel, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (conv_id * 30 + turn), '%Y-%m-%d') AS day, count(*)::BIGINT AS messages, array_to_string(list_sort(list_distinct(list(role))), ',') AS participants FROM conversations GROUP BY 1, 2")
def channel_days(spark, d):
    c = read(spark, d, "conversations")
    ts = F.timestamp_seconds(F.lit(1704067200) + 60 * (F.col("conv_id") * 30 + F.col("turn")))
    rows = c.select(F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string")).alias("channel"), ts.alias("ts"), F.col("role").alias("user"), "text", F.lit(None).cast("string").alias("thread"))
    return SM.channel_days(rows).select("channel", F.date_format("day", "yyyy-MM-dd").alias("day"), "messages", F.array_join("participants", ",").alias("participants"))


HINT = "SELECT '{c}' AS \"column\", CASE WHEN bool_and(regexp_matches({c}::VARCHAR, '^\\s*-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?\\s*$')) THEN 'number' WHEN count(DISTINCT {c}) <= 6 THEN 'category' ELSE 'text' END AS hint, count(DISTINCT {c})::BIGINT AS distinct_values FROM orders"


@query(" UNION ALL ".join(HINT.format(c=c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")))
def column_hints(spark, d):
    return SS.column_hints(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])utm_[a-z]+=[^&]*', '\\1', 'g'), '[?&]+$', ''), '/$', '') AS url FROM pages")
def normalized_urls(spark, d):
    return read(spark, d, "pages").select("page_id", T.normalized_url(F.col("url")).alias("url"))


@query("SELECT source AS source_class_of, count(*)::BIGINT AS words_rows, greatest(1, round(sum(len(string_split_regex(trim(text), '\\s+'))) * 100 / 75.0))::BIGINT AS corpus_tokens FROM documents GROUP BY source")
def corpus_tokens(spark, d):
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return read(spark, d, "documents").groupBy(F.col("source").alias("source_class_of")).agg(F.count("*").alias("words_rows"), F.greatest(F.lit(1), F.round(F.sum(words) * 100 / 75.0)).cast("long").alias("corpus_tokens"))


@query("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), x AS (SELECT 1 AS prefix_id, string_split(path, '/')[1] AS prefix FROM p UNION SELECT 2, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM p WHERE len(string_split(path, '/')) > 2)
SELECT path, (SELECT prefix_id FROM x WHERE path = prefix OR starts_with(path, prefix || '/') ORDER BY length(prefix) DESC, prefix_id LIMIT 1)::BIGINT AS prefix_id FROM p""")
def project_of_path(spark, d):
    paths = read(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()
    parts = F.split("path", "/")
    prefixes = paths.select(F.lit(1).cast("long").alias("prefix_id"), parts[0].alias("prefix")).union(paths.where(F.size(parts) > 2).select(F.lit(2).cast("long"), F.concat_ws("/", parts[0], parts[1]))).distinct()
    return A.longest_prefix(paths, prefixes)
