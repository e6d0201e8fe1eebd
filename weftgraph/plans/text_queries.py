"""Queries over texts: redaction, hashing, tokens, claims, terms, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.scoring import large_graph_defaults
from weftgraph.operators import analysis as A
from weftgraph.plans.model import read, strings
from weftgraph.sources import ignores as IG
from weftgraph.session import with_checkpoints

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


TOKEN = "'[a-z0-9][a-z0-9-]{1,}'"
NORMAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SENTENCES = rf"list_filter(string_split(regexp_replace({NORMAL}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
NEG, POS = T.NEGATIVE.replace("'", "''"), T.POSITIVE
POLARITY = f"CASE WHEN regexp_matches(claim, '(?i){NEG}') THEN 'negative' WHEN regexp_matches(claim, '(?i){POS}') THEN 'positive' ELSE 'neutral' END"
CLAIMS = f"(SELECT doc_id, unnest(s[1:4]) AS claim, unnest(range(1, least(len(s), 4) + 1)) AS nth FROM (SELECT doc_id, {SENTENCES} AS s FROM documents))"
TERMS = f"""(SELECT doc_id, term, n, rank FROM (SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS rank
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TOKEN})) AS term FROM documents) WHERE length(term) >= 4 AND term NOT IN ({strings(T.CLOSED_CLASS)}) GROUP BY doc_id, term) WHERE rank <= 6)"""
SLUG = lambda c: f"coalesce(nullif(substr(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'item')"
#: Patterns of one's own beside the built-in ones: what these tables hold.
OWN_PATTERNS = {"email": r"[A-Za-z0-9._-]+@[a-z0-9.-]+[a-z]", "hex_token": r"token = \"[0-9a-f]{40}\"", "card": r"\b4[0-9]{15}\b", "phone": r"[+]1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"}
PATTERN_SQL = " UNION ALL ".join(
    "SELECT '{}' AS pattern, sum(len(regexp_extract_all(text, '{}')))::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(text, '{}'))::BIGINT AS docs FROM documents".format(n, p.replace("'", "''"), p.replace("'", "''")) for n, p in [*((n, p) for n, p, _ in T.REDACTIONS), *OWN_PATTERNS.items()]
)


@query(f"SELECT * FROM ({PATTERN_SQL}) WHERE n > 0")
def redaction_counts(spark, d):
    counts = T.redact(F.col("text"), OWN_PATTERNS, needs={"email": "@", "hex_token": 'token = "', "phone": "+1 ("})[1]
    return read(spark, d, "documents").select(F.explode(counts).alias("pattern", "k")).groupBy("pattern").agg(F.sum("k").cast("long").alias("n"), F.count("*").alias("docs"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(f"SELECT doc_id, {SLUG('substr(text, 1, 60)')} AS slug, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS cut, list_aggregate({SENTENCES}[1:2], 'string_agg', ' ') AS opening FROM documents")
def titles(spark, d):
    c = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.slugify(F.substring(c, 1, 60)).alias("slug"), T.truncate(c, 40).alias("cut"), T.first_sentences(T.normalize_whitespace(c), 2).alias("opening"))


@query(
    f"SELECT doc_id, len(regexp_extract_all(lower(text), {TOKEN}))::BIGINT AS tokens, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')), lambda t: t NOT IN ({strings(T.CLAIM_STOPWORDS)})))::BIGINT AS claim_tokens FROM documents"
)
def token_counts(spark, d):
    c = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.size(T.tokens(c)).cast("long").alias("tokens"), F.size(T.claim_tokens(c)).cast("long").alias("claim_tokens"))


CODE_LINE = " OR ".join([f"starts_with(trim(l), '{s}')" for s in ("```", "- `", "import ", "export ", "const ", "function ", "class ", "def ", "fn ")] + [r"regexp_matches(trim(l), '^[{}\[\]();]')", r"regexp_matches(trim(l), '^\w+\s*[=:]\s*')"])


@query(f"SELECT doc_id, CAST(ceil(round(sum(CASE WHEN {CODE_LINE} THEN length(l) / 3.0 ELSE length(l) / 4.0 END), 6)) AS BIGINT) AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def token_estimates(spark, d):
    return read(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, nth::BIGINT AS nth, claim, {POLARITY} AS polarity FROM {CLAIMS}")
def claim_polarity(spark, d):
    return A.claims(read(spark, d, "documents")).select("doc_id", F.col("at").cast("long").alias("nth"), "claim", "polarity")


@query(f"SELECT doc_id, term, n::BIGINT AS n, rank::BIGINT AS rank FROM {TERMS}")
def top_terms(spark, d):
    return A.top_terms(read(spark, d, "documents")).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT 'concept:' || slug AS id, arg_min(term, (doc_id, term)) AS name, count(DISTINCT doc_id)::BIGINT AS sources, round(least(0.5 + 0.15 * count(DISTINCT doc_id), 0.95), 6)::DOUBLE AS confidence FROM (SELECT *, {SLUG('term')} AS slug FROM {TERMS}) GROUP BY slug")
def concept_nodes(spark, d):
    return A.aggregate_terms(A.top_terms(read(spark, d, "documents")))


@query(f"""SELECT t.doc_id, t.term, round(coalesce(avg(0.5 + 0.1 * c.nth) FILTER (WHERE contains(lower(c.claim), t.term)), 0.5), 6)::DOUBLE AS confidence FROM {TERMS} t LEFT JOIN {CLAIMS} c ON c.doc_id = t.doc_id GROUP BY t.doc_id, t.term""")
def mention_edges(spark, d):
    docs = read(spark, d, "documents")
    said = A.claims(docs).withColumn("confidence", 0.5 + 0.1 * F.col("at"))
    return A.mention_edges(A.top_terms(docs), said).withColumn("confidence", F.round("confidence", 6))


POLAR = f"(SELECT t.term AS concept, c.doc_id AS source, c.nth, {POLARITY} AS polarity, 0.5 + 0.1 * c.nth AS confidence FROM {TERMS} t JOIN {CLAIMS} c ON c.doc_id = t.doc_id WHERE contains(lower(c.claim), t.term))"


@query(f"""WITH polar AS {POLAR}, pairs AS (SELECT p.concept, least(p.source, n.source) AS a, greatest(p.source, n.source) AS b, p.nth AS pa, n.nth AS na, least(p.confidence, n.confidence) AS confidence FROM polar p JOIN polar n ON p.concept = n.concept AND p.source <> n.source WHERE p.polarity = 'positive' AND n.polarity = 'negative')
SELECT concept, a, b, round(confidence, 6)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY concept, pa, na) AS rn FROM pairs) WHERE rn = 1""")
def conflict_edges(spark, d):
    docs = read(spark, d, "documents")
    polar = A.top_terms(docs).select("doc_id", "term").join(A.claims(docs), "doc_id").where(F.contains(F.lower("claim"), F.col("term"))).select(F.col("term").alias("concept"), F.col("doc_id").alias("source"), "at", "polarity", (0.5 + 0.1 * F.col("at")).alias("confidence"))
    return A.conflicts(polar).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH c AS (SELECT doc_id * 10 + nth AS id, doc_id, {POLARITY} AS polarity, list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z][a-z0-9-]{{2,}}')), lambda t: t NOT IN ({strings(T.CLAIM_STOPWORDS)})) AS w FROM {CLAIMS}),
s AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS t FROM c a JOIN c b ON a.id < b.id AND a.doc_id <> b.doc_id AND ((a.polarity = 'positive' AND b.polarity = 'negative') OR (a.polarity = 'negative' AND b.polarity = 'positive')))
SELECT left_id, right_id, round(i / (t - i), 6)::DOUBLE AS similarity FROM s WHERE t > i AND i / (t - i) >= 0.02""")
def contradictions(spark, d):
    """With a threshold far below the default of 0.3: claims of these tables share few words."""
    said = A.claims(read(spark, d, "documents")).select((F.col("doc_id") * 10 + F.col("at")).alias("id"), F.col("doc_id").alias("source"), "claim", "polarity")
    return A.contradictions(said, 0.02).withColumn("similarity", F.round("similarity", 6))


FEATURES = f"(SELECT doc_id AS id, lang AS type, 'shared_concept' AS reason, term AS value FROM {TERMS} JOIN documents USING (doc_id) UNION SELECT doc_id, lang, 'shared_source_type', source FROM documents)"


@query(f"""WITH f AS {FEATURES}, total AS (SELECT count(DISTINCT id) AS n FROM f), idf AS (SELECT reason, value, ln((greatest(n, 1) + 1) / (count(*) + 1)) + 1 AS idf FROM f, total GROUP BY reason, value, n),
hit AS (SELECT a.id AS a, b.id AS b, a.reason, idf.idf, row_number() OVER (PARTITION BY a.id, b.id, a.reason ORDER BY a.value) AS k FROM f a JOIN f b ON a.type = b.type AND a.reason = b.reason AND a.value = b.value AND a.id < b.id JOIN idf ON idf.reason = a.reason AND idf.value = a.value WHERE idf.idf >= 0.5),
part AS (SELECT a, b, reason, sum(CASE WHEN k = 1 THEN least(2 * w, w * idf) ELSE least(0.12, 0.04 * idf) END) AS part FROM (SELECT *, CASE reason WHEN 'shared_concept' THEN 0.46 ELSE 0.1 END AS w FROM hit) GROUP BY a, b, reason),
pair AS (SELECT a, b, least(0.96, sum(part) + CASE WHEN count(*) >= 3 THEN 0.08 WHEN count(*) = 2 THEN 0.04 ELSE 0 END) AS c FROM part GROUP BY a, b)
SELECT a, b, round(c, 6)::DOUBLE AS confidence FROM pair WHERE c >= 0.5 QUALIFY row_number() OVER (ORDER BY round(c, 9) DESC, a, b) <= (SELECT least(5 * count(*), 20000) FROM documents)""")
def similarity_edges(spark, d):
    with_checkpoints(spark)
    docs = read(spark, d, "documents")
    terms = A.top_terms(docs).select("doc_id", "term").join(docs.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.lit("shared_concept").alias("reason"), F.col("term").alias("value"))
    features = terms.unionByName(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.lit("shared_source_type").alias("reason"), F.col("source").alias("value")))
    scopes = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("page_id"), F.array(F.col("doc_id").cast("string")).alias("source_ids"))
    return A.similarity_edges(features, scopes, limit=large_graph_defaults(docs.count())["similarity_edges"]).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH said AS (SELECT doc_id, string_agg(claim, chr(10) ORDER BY nth) AS claims, string_agg({POLARITY}, ',' ORDER BY nth) AS polarities FROM {CLAIMS} GROUP BY doc_id)
SELECT documents.doc_id, coalesce(claims, '') AS claims, coalesce(polarities, '') AS polarities, coalesce(nullif(list_aggregate({SENTENCES}[1:3], 'string_agg', ' '), ''), {NORMAL}) AS summary, coalesce((SELECT string_agg('concept:' || {SLUG('term')}, ',' ORDER BY rank) FROM {TERMS} t WHERE t.doc_id = documents.doc_id), '') AS concepts FROM documents LEFT JOIN said USING (doc_id)""")
def heuristic_analysis(spark, d):
    return A.heuristic_analysis(read(spark, d, "documents")).select("doc_id", "summary", F.array_join("concepts", ",").alias("concepts"), F.array_join("claims", "\n").alias("claims"), F.array_join("polarities", ",").alias("polarities"))


PAGE_PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '')"


@query(rf"""WITH p AS (SELECT DISTINCT {PAGE_PATH} AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS parts FROM p),
k AS (SELECT path, regexp_matches(path, '(^|/)fr/[^/]+(/|$)') AS included, regexp_matches(path, '(^|/)m\.[^/]*/') OR len(list_filter(parts, lambda x: x LIKE '%5' AND x NOT LIKE '%25')) > 0 AS git, regexp_matches(path, '^blog\.[^/]*/en/8[^/]*(/|$)') AS own FROM s)
SELECT path, CASE WHEN included THEN NULL WHEN git THEN 'gitignore' WHEN own THEN 'ignore' END AS reason FROM k""")
def ignored_paths(spark, d):
    """Paths of pages under rule files: one for all, one in the folder of each blog, and exceptions."""
    pages = read(spark, d, "pages").selectExpr(rf"{PAGE_PATH.replace(chr(92), chr(92) * 2)} AS path").distinct()
    top = spark.createDataFrame([("", "gitignore", "# all\nm.*/\n*5\n!*25\n"), ("", "include", "**/fr/*\n")], "dir string, kind string, text string")
    blogs = pages.select(F.split("path", "/")[0].alias("dir")).where("dir like 'blog.%'").distinct().select("dir", F.lit("ignore").alias("kind"), F.lit("en/8*").alias("text"))
    return IG.ignore_reasons(pages, top.unionByName(blogs)).select("path", F.col("ignore_reason").alias("reason"))
