"""Queries over the graph: statistics, filters, metrics, traversals, validation."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import louvain as LV
from weftgraph.operators import metrics as M
from weftgraph.operators import traverse as Q
from weftgraph.operators import walks as W
from weftgraph.plans.model import WITH, graph, read
from weftgraph.session import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"""{WITH} SELECT 'node_type' AS dimension, type AS name, count(*)::BIGINT AS n FROM nodes GROUP BY type UNION ALL SELECT 'node_class', coalesce(source_class, 'first_party'), count(*) FROM nodes GROUP BY 2
UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'evidence_class', evidence_class, count(*) FROM edges GROUP BY 2""")
def graph_stats(spark, d):
    return G.stats(graph(spark, d))


@query(f"{WITH} SELECT " + ", ".join(f"(count(*) FILTER (WHERE source_class = '{c}'))::BIGINT AS {c}" for c in G.CLASSES) + " FROM nodes")
def class_breakdown(spark, d):
    return G.class_breakdown(graph(spark, d).nodes)


KEPT = "SELECT e.* FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.relation IN ('supports', 'contradicts', 'builds_on', 'mentions', 'imports', 'exports', 'contains_code') AND e.evidence_class = 'extracted' AND (coalesce(s.type IN ('module', 'entity'), FALSE) OR coalesce(t.type IN ('module', 'entity'), FALSE))"


@query(f"{WITH}, kept AS ({KEPT}) SELECT 'edge' AS part, id FROM kept UNION ALL SELECT 'node', id FROM nodes WHERE type IN ('module', 'entity') OR id IN (SELECT source FROM kept UNION SELECT target FROM kept)")
def filtered_graph(spark, d):
    g = G.filter_for_query(graph(spark, d), relation_groups=("evidence", "imports"), evidence=("extracted",), types=("module", "entity"))
    return g.edges.select(F.lit("edge").alias("part"), "id").unionByName(g.nodes.select(F.lit("node").alias("part"), "id"))


@query(f"{WITH} SELECT e.id, e.relation FROM edges e WHERE e.source IN (SELECT id FROM nodes WHERE source_class = 'first_party') AND e.target IN (SELECT id FROM nodes WHERE source_class = 'first_party')")
def first_party_graph(spark, d):
    return G.of_class(graph(spark, d), "first_party").edges.select("id", "relation")


@query(f"{WITH}, n AS (SELECT id FROM nodes WHERE home IS NULL OR home NOT IN ('nation:1', 'nation:2', 'region:3')) SELECT 'node' AS part, id FROM n UNION ALL SELECT 'edge', id FROM edges WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)")
def removal_projection(spark, d):
    g = G.without_sources(graph(spark, d), spark.createDataFrame([("nation:1",), ("nation:2",), ("region:3",)], "source_id string"))
    return g.nodes.select(F.lit("node").alias("part"), "id").unionByName(g.edges.select(F.lit("edge").alias("part"), "id"))


def _two(g):
    """The graph without the links of small balances, and without one part of its nodes: an earlier state."""
    return g.edges.where("confidence >= 0.2"), g.edges.where("confidence < 0.9 or relation <> 'mentions'")


@query(f"{WITH}, a AS (SELECT * FROM edges WHERE confidence >= 0.2), b AS (SELECT * FROM edges WHERE confidence < 0.9 OR relation <> 'mentions') SELECT 'added' AS change, id FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'removed', id FROM a WHERE id NOT IN (SELECT id FROM b)")
def edge_diff(spark, d):
    return G.diff(*_two(graph(spark, d)))


@query(f"""{WITH}, a AS MATERIALIZED (SELECT id, round(confidence, 1) AS v FROM edges WHERE confidence >= 0.2), b AS MATERIALIZED (SELECT id, round(confidence * confidence, 1) AS v FROM edges WHERE confidence < 0.9 OR relation <> 'mentions'),
u AS (SELECT id, count(*) FILTER (WHERE old) AS was, count(*) FILTER (WHERE NOT old) AS now, min(v) = max(v) AS same FROM (SELECT id, v, TRUE AS old FROM a UNION ALL SELECT id, v, FALSE FROM b) GROUP BY id) SELECT id, CASE WHEN was = 0 THEN 'created' WHEN now = 0 THEN 'removed' WHEN same THEN 'unchanged' ELSE 'updated' END AS change FROM u""")
def edge_changes(spark, d):
    a, b = _two(graph(spark, d))
    return G.changes(a.withColumn("v", F.round("confidence", 1)), b.withColumn("v", F.round(F.col("confidence") * F.col("confidence"), 1)), "id", "v")


@query(f"{WITH}, a AS (SELECT count(*) AS n FROM edges WHERE confidence >= 0.2), b AS (SELECT count(*) AS m FROM edges WHERE confidence < 0.9 OR relation <> 'mentions') SELECT n::BIGINT AS before, m::BIGINT AS after, greatest(0.0, (n - m) / n)::DOUBLE AS drop_ratio, greatest(0.0, (n - m) / n) > 0.25 AS blocked FROM a, b")
def shrink_guard(spark, d):
    return G.shrink_guard(*_two(graph(spark, d)))


@query(f"{WITH} SELECT p || ':' || id AS id, p || ':' || source AS source, p || ':' || target AS target, relation FROM edges, (SELECT 'left' AS p UNION ALL SELECT 'right') x WHERE p = 'left' OR confidence >= 0.5")
def merged_graphs(spark, d):
    g = graph(spark, d)
    return G.merge({"left": g, "right": G.Graph(g.nodes, g.edges.where("confidence >= 0.5"))}).edges.select("id", "source", "target", "relation")


HYPER = "SELECT {hub} AS hub, string_agg({member}, ',' ORDER BY {member}) AS members, round(least({cap}, {base} + {step} * count(*)), 6)::DOUBLE AS confidence FROM (SELECT DISTINCT source, target FROM edges WHERE {where}) GROUP BY 1 HAVING count(*) >= 3"


@query(f"{WITH} " + HYPER.format(hub="target", member="source", cap=0.96, base=0.72, step=0.06, where="relation = 'mentions' AND source LIKE 'customer:%'"))
def topic_hyperedges(spark, d):
    g = graph(spark, d)
    return G.topic_hyperedges(g.nodes, g.edges).select("hub", F.array_join("node_ids", ",").alias("members"), "confidence")


@query(f"{WITH} " + HYPER.format(hub="source", member="target", cap=0.98, base=0.78, step=0.04, where="relation = 'defines'"))
def module_hyperedges(spark, d):
    return G.module_hyperedges(graph(spark, d).edges).select("hub", F.array_join("node_ids", ",").alias("members"), "confidence")


@query(f"{WITH}, h AS (SELECT source AS hub, count(DISTINCT target) AS n FROM edges WHERE relation = 'defines' GROUP BY source HAVING count(DISTINCT target) >= 3) SELECT DISTINCT h.hub, e.target, round(least(0.98, 0.78 + 0.04 * n), 6)::DOUBLE AS confidence FROM h JOIN edges e ON e.source = h.hub AND e.relation = 'defines'")
def hyperedge_hubs(spark, d):
    g = graph(spark, d)
    hyper = G.module_hyperedges(g.edges).withColumn("evidence_class", F.lit("inferred"))
    edges = G.hubs(G.Graph(g.nodes, g.edges, hyper))[1]
    return edges.join(hyper.select(F.concat(F.lit("hyper:"), "id").alias("source"), "hub"), "source").select("hub", "target", "confidence")


@query(f"""{WITH}, bad AS (SELECT id, CASE WHEN id LIKE 'e:s:%' THEN 'supplier:none' ELSE source END AS source, target, CASE WHEN id LIKE 'e:n:%' THEN '' ELSE relation END AS relation, CASE WHEN id LIKE 'e:i:%' THEN 1.5 ELSE confidence END AS confidence FROM edges UNION ALL SELECT id, source, target, relation, confidence FROM edges WHERE id LIKE 'e:n:%')
SELECT 'duplicate_edge_id' AS code, id AS item FROM bad GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'invalid_confidence', 'edge:' || id FROM bad WHERE confidence > 1 UNION ALL SELECT 'empty_relation', id FROM bad WHERE relation = '' UNION ALL SELECT 'dangling_edge_source', id FROM bad WHERE source = 'supplier:none'""")
def validation(spark, d):
    g = graph(spark, d)
    is_ = lambda p: F.col("id").startswith(p)
    bad = g.edges.withColumn("source", F.when(is_("e:s:"), "supplier:none").otherwise(F.col("source"))).withColumn("relation", F.when(is_("e:n:"), "").otherwise(F.col("relation"))).withColumn("confidence", F.when(is_("e:i:"), 1.5).otherwise(F.col("confidence")))
    return G.validate(G.Graph(g.nodes, bad.unionByName(g.edges.where(is_("e:n:")))))


@query(f"{WITH} SELECT id, 'type' AS key, type AS value FROM nodes UNION ALL SELECT id, 'label', label FROM nodes UNION ALL SELECT id, 'source_class', source_class FROM nodes WHERE source_class IS NOT NULL UNION ALL SELECT id, 'source_ids', CASE WHEN home IS NULL THEN '[]' ELSE '[\"' || home || '\"]' END FROM nodes")
def node_properties(spark, d):
    return G.primitive_properties(graph(spark, d).nodes.select("id", "type", "label", "source_class", "source_ids"))


NEAR = "near AS (SELECT DISTINCT id, neighbor FROM (SELECT source AS id, target AS neighbor FROM edges UNION ALL SELECT target, source FROM edges)), degree AS (SELECT n.id, n.type, count(neighbor) AS degree FROM nodes n LEFT JOIN near ON near.id = n.id GROUP BY n.id, n.type)"


@query(f"""{WITH}, {NEAR}, own AS (SELECT degree, row_number() OVER (ORDER BY degree DESC) - 1 AS i FROM degree WHERE type <> 'source'), s AS (SELECT avg(degree) AS mean, stddev_pop(degree) AS std, count(*) AS n FROM own), c AS (SELECT degree AS least FROM own, s WHERE i = greatest(0, floor(n * 0.1) - 1))
SELECT id, degree::BIGINT AS degree, (type <> 'source' AND degree >= least AND degree > 0) AS is_god, CASE WHEN (degree - mean) / std >= 1.5 THEN round((degree - mean) / std, 4) END::DOUBLE AS sigma FROM degree, s, c""")
def god_nodes(spark, d):
    g = graph(spark, d)
    return M.god_nodes(M.degrees(g.nodes, M.adjacency(g.nodes, g.edges))).select("id", "degree", "is_god", "sigma")


def _homes(g):
    """Communities by home: members of a nation, else of a region."""
    return g.nodes.where("home is not null").select("id", F.col("home").alias("community_id"))


@query(f"{WITH}, {NEAR}, m AS (SELECT id, home FROM nodes WHERE home IS NOT NULL), seen AS (SELECT near.id, count(DISTINCT coalesce(o.home, s.home)) AS n FROM near LEFT JOIN m o ON o.id = neighbor LEFT JOIN m s ON s.id = near.id GROUP BY near.id) SELECT nodes.id, CASE WHEN type = 'source' THEN coalesce(n, 0) ELSE greatest(0, coalesce(n, 0) - 1) END::BIGINT AS bridge_score FROM nodes LEFT JOIN seen ON seen.id = nodes.id")
def bridge_scores(spark, d):
    g = graph(spark, d)
    return M.bridge_scores(g.nodes, M.adjacency(g.nodes, g.edges), _homes(g))


@query(f"{WITH}, {NEAR}, m AS (SELECT id, home FROM nodes WHERE home IS NOT NULL), sz AS (SELECT home, count(*) AS size FROM m GROUP BY home), inn AS (SELECT a.home, count(*) AS n FROM near JOIN m a ON a.id = near.id JOIN m b ON b.id = neighbor WHERE near.id < neighbor AND a.home = b.home GROUP BY a.home) SELECT sz.home AS community_id, size::BIGINT AS size, coalesce(n, 0)::BIGINT AS inner_links, CASE WHEN size < 2 THEN 1 ELSE coalesce(n, 0) / (size * (size - 1) / 2) END::DOUBLE AS cohesion FROM sz LEFT JOIN inn ON inn.home = sz.home")
def community_cohesion(spark, d):
    g = graph(spark, d)
    return M.cohesion(_homes(g), M.adjacency(g.nodes, g.edges)).withColumnRenamed("inner", "inner_links")


@query(f"""{WITH}, {NEAR}, m AS (SELECT id, home FROM nodes WHERE home IS NOT NULL), seen AS (SELECT near.id, count(DISTINCT coalesce(o.home, s.home)) AS n FROM near LEFT JOIN m o ON o.id = neighbor LEFT JOIN m s ON s.id = near.id GROUP BY near.id),
x AS (SELECT nodes.*, CASE WHEN type = 'source' THEN coalesce(n, 0) ELSE greatest(0, coalesce(n, 0) - 1) END AS bridge FROM nodes LEFT JOIN seen ON seen.id = nodes.id),
hm AS (SELECT target AS hub, source AS node FROM edges WHERE relation = 'mentions' AND source LIKE 'customer:%' UNION SELECT target, target FROM edges WHERE relation = 'mentions' AND source LIKE 'customer:%')
SELECT e.id, round(least(0.99, e.confidence * 0.45 + CASE WHEN s.home <> t.home THEN 0.18 ELSE 0 END + CASE WHEN s.page_id <> t.page_id THEN 0.12 ELSE 0 END + CASE WHEN s.type <> t.type THEN 0.08 ELSE 0 END + CASE WHEN s.language <> t.language THEN 0.07 ELSE 0 END + CASE WHEN coalesce(s.bridge, 0) > 0 OR coalesce(t.bridge, 0) > 0 THEN 0.08 ELSE 0 END + CASE WHEN e.evidence_class = 'ambiguous' THEN 0.08 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM hm a JOIN hm b ON a.hub = b.hub WHERE a.node = e.source AND b.node = e.target) THEN 0.06 ELSE 0 END), 6)::DOUBLE AS score
FROM edges e LEFT JOIN x s ON s.id = e.source LEFT JOIN x t ON t.id = e.target ORDER BY 2 DESC, 1 LIMIT 200""")
def surprising_edges(spark, d):
    g = graph(spark, d)
    bridge = M.bridge_scores(g.nodes, M.both_ways(g.edges), _homes(g))
    nodes = g.nodes.join(bridge, "id").select("id", F.col("home").alias("community_id"), "page_id", "type", F.col("language").alias("source_type"), "bridge_score")
    topics = G.topic_hyperedges(g.nodes, g.edges)
    inside = topics.select("id", F.explode(F.concat("node_ids", F.array("hub"))).alias("node_id"))
    return M.surprise(g.edges, nodes, inside).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(200)


@query(f"{WITH}, {NEAR} SELECT (SELECT count(*) FROM degree WHERE type <> 'source' AND degree <= 1)::BIGINT AS isolated, (SELECT count(*) FROM (SELECT home FROM nodes WHERE home IS NOT NULL GROUP BY home HAVING count(*) <= 2))::BIGINT AS thin, (SELECT round(avg(CASE WHEN evidence_class = 'ambiguous' THEN 1 ELSE 0 END), 6) FROM edges)::DOUBLE AS ambiguous")
def knowledge_gaps(spark, d):
    g = graph(spark, d)
    sizes = _homes(g).groupBy("community_id").agg(F.count("*").alias("size"))
    return M.knowledge_gaps(M.degrees(g.nodes, M.adjacency(g.nodes, g.edges)), sizes, g.edges).withColumn("ambiguous", F.round("ambiguous", 6))


@query(f"{WITH}, m AS (SELECT home AS community_id, count(*) AS size, min(id) AS first FROM nodes WHERE home IS NOT NULL GROUP BY home) SELECT community_id, size::BIGINT AS size, row_number() OVER (ORDER BY size DESC, first)::BIGINT AS rank FROM m")
def community_order(spark, d):
    return M.community_nodes(_homes(graph(spark, d))).select("community_id", "size", F.col("rank").cast("long").alias("rank"))


def _detected(spark, d):
    g = graph(spark, d)
    return g, LV.communities(g.nodes, M.adjacency(g.nodes, g.edges))


@query()
def detected_communities(spark, d):
    """Louvain with contraction and splitting; sources take their first neighbour's community. ``community_checks`` and tests hold its invariants."""
    g, found = _detected(spark, d)
    return LV.with_sources(g.nodes, g.edges, found.members).withColumnRenamed("community", "community_id")


@query(f"""{WITH}, own AS (SELECT id FROM nodes WHERE type <> 'source'), near AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)
SELECT 'members' AS check_name, count(*)::BIGINT AS n FROM own UNION ALL SELECT 'placed_sources', count(DISTINCT a) FROM near JOIN nodes n ON n.id = a AND n.type = 'source' JOIN own ON own.id = b
UNION ALL SELECT * FROM (VALUES ('repeated_members', 0), ('falls_of_modularity', 0), ('communities_without_their_name', 0), ('modularity_under_singletons', 0))""")
def community_checks(spark, d):
    """Invariants of the detected communities: each node once, modularity never falls, a community is named by its least member, sources are placed where a neighbour is."""
    g, found = _detected(spark, d)
    members = found.members
    counted = lambda name, df: df.select(F.lit(name).alias("check_name"), F.col("n").cast("long").alias("n"))
    falls = sum(b < a - 1e-9 for a, b in zip(found.modularity, found.modularity[1:], strict=False))
    least = members.groupBy("community").agg(F.min("id").alias("low")).agg(F.count_if(F.col("low") != F.col("community")).alias("n"))
    links = written(LV.simple_links(g.nodes, M.adjacency(g.nodes, g.edges)).select(F.col("a").alias("id"), F.col("b").alias("neighbor")), "links")
    both = M.modularity(links, members.select("id", F.col("community").alias("community_id"))).crossJoin(M.modularity(links, members.select("id", F.col("id").alias("community_id"))).withColumnRenamed("modularity", "alone"))  # one row each
    rows = [
        ("members", members.agg(F.count("*").alias("n"))), ("placed_sources", LV.with_sources(g.nodes, g.edges, members).join(g.nodes.where("type = 'source'").select("id"), "id", "left_semi").agg(F.count("*").alias("n"))),
        ("repeated_members", members.groupBy("id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))), ("falls_of_modularity", spark.range(1).select(F.lit(falls).alias("n"))),
        ("communities_without_their_name", least), ("modularity_under_singletons", both.select((F.col("modularity") < F.col("alone")).cast("int").alias("n"))),
    ]
    return functools.reduce(lambda x, y: x.unionByName(y), [counted(*r) for r in rows])


@query(f"{WITH}, walk AS (SELECT 'supplier:1' AS id, 0 AS depth UNION SELECT e.source, w.depth + 1 FROM walk w JOIN edges e ON e.target = w.id AND e.relation = 'imports' WHERE w.depth < 2) SELECT id, min(depth)::BIGINT AS depth FROM walk GROUP BY id HAVING min(depth) > 0")
def blast_radius(spark, d):
    from weftgraph.session import with_checkpoints

    with_checkpoints(spark)
    return Q.blast_radius(graph(spark, d).edges, "supplier:1", 2).withColumn("depth", F.col("depth").cast("long"))


@query(f"{WITH}, {NEAR}, walk AS (SELECT 'customer:1' AS id, 0 AS depth UNION SELECT near.neighbor, w.depth + 1 FROM walk w JOIN near ON near.id = w.id WHERE w.depth < 3) SELECT id, min(depth)::BIGINT AS depth FROM walk GROUP BY id")
def neighborhood(spark, d):
    from weftgraph.session import with_checkpoints

    with_checkpoints(spark)
    return Q.reach(graph(spark, d).edges, "customer:1", 3).select("id", F.col("depth").cast("long").alias("depth"))


@query(f"{WITH}, {NEAR}, walk AS (SELECT 'customer:1' AS id, 0 AS depth UNION SELECT near.neighbor, w.depth + 1 FROM walk w JOIN near ON near.id = w.id WHERE w.depth < 8), d AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id), back AS (SELECT 'part:1' AS id, depth AS step FROM d WHERE id = 'part:1' UNION ALL SELECT (SELECT min(near.id) FROM near JOIN d ON d.id = near.id WHERE near.neighbor = back.id AND d.depth = back.step - 1), back.step - 1 FROM back WHERE back.step > 0) SELECT step::BIGINT AS step, id FROM back")
def path_length(spark, d):
    from weftgraph.session import with_checkpoints

    with_checkpoints(spark)
    path = Q.shortest_path(graph(spark, d).edges, "customer:1", "part:1")
    return spark.createDataFrame(list(enumerate(path)), "step long, id string")


@query(f"{WITH} SELECT CASE WHEN e.source = 'supplier:1' THEN e.target ELSE e.source END AS id, e.relation, round(e.confidence, 6)::DOUBLE AS confidence, CASE WHEN e.source = 'supplier:1' THEN 'out' ELSE 'in' END AS direction FROM edges e WHERE e.source = 'supplier:1' OR e.target = 'supplier:1'")
def node_neighbors(spark, d):
    g = graph(spark, d)
    return Q.explain(g.nodes, g.edges, "supplier:1").select("id", "relation", F.round("confidence", 6).alias("confidence"), "direction")


@query(f"{WITH} SELECT id, CASE WHEN lower(label) = 'supplier#000000001' THEN 100 WHEN starts_with(lower(label), 'supplier#000000001') THEN 80 WHEN contains(lower(label), 'supplier#000000001') THEN 60 END::BIGINT AS score FROM nodes WHERE contains(lower(label), 'supplier#000000001')")
def resolved_names(spark, d):
    return Q.resolve(graph(spark, d).nodes, "Supplier#000000001", 1000).select("id", F.col("score").cast("long").alias("score"))


@query()
def graph_query(spark, d):
    """Bounded walk from the best matches of a question."""
    g = graph(spark, d)
    return Q.query(g.nodes, g.edges, "Supplier#000000001", 12)


def _asked(spark, d):
    """The graph with nations as pages, and a question for each part whose key is divisible by 100: its name and its type."""
    g = graph(spark, d)
    pages = read(spark, d, "nation").select(F.concat(F.lit("page:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("nations/"), F.lower("n_name"), F.lit(".md")).alias("path"), F.lit("concept").alias("kind"))
    asked = read(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return G.Graph(g.nodes.withColumn("community_id", F.col("home")), g.edges, pages=pages), asked


SCORE = "CASE WHEN c = q THEN 100 WHEN starts_with(c, q) THEN 80 WHEN contains(c, q) THEN 60 ELSE 10 * len(list_filter(string_split(q, ' '), lambda w: list_contains(string_split(c, ' '), w))) END"


@query(f"""{WITH}, asked AS (SELECT p_partkey AS query_id, lower(trim(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g'))) AS q FROM part WHERE p_partkey % 100 = 0),
said AS (SELECT 'node' AS kind, 1 AS o, id, label, unnest([label, id]) AS c FROM nodes UNION ALL SELECT 'page', 0, 'page:' || n_nationkey::VARCHAR, n_name, unnest([n_name, 'nations/' || lower(n_name) || '.md']) FROM nation),
m AS (SELECT query_id, kind, o, id, label, max({SCORE}) AS score FROM asked, (SELECT * REPLACE (lower(trim(regexp_replace(c, '\\s+', ' ', 'g'))) AS c) FROM said) WHERE c <> '' GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, o, id)::BIGINT AS rank, kind, id, label, score::BIGINT AS score FROM m WHERE score > 0 QUALIFY rank <= 12""")
def walk_matches(spark, d):
    g, asked = _asked(spark, d)
    return W.matches(g, asked).withColumns({"rank": F.col("rank").cast("long"), "score": F.col("score").cast("long")})


@query()
def graph_walks(spark, d):
    """All questions walked at once, with what each walk costs as context; tests hold it against a plain walk of each question."""
    g, asked = _asked(spark, d)
    went = written(W.ask(g, asked), "asked")
    return went.join(W.context(g, went).select("query_id", "tokens"), "query_id").select("query_id", F.array_join("visited", ",").alias("visited"), F.size("edges").alias("edges"), F.array_join("pages", ",").alias("pages"), F.array_join("communities", ",").alias("communities"), "tokens")


@query("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), s AS (SELECT string_split(path, '/') AS x FROM p), n AS (SELECT DISTINCT array_to_string(x[1:i], '/') AS path, CASE WHEN i > 1 THEN array_to_string(x[1:i-1], '/') END AS parent, i::BIGINT AS depth FROM s, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i))
SELECT n.path, n.parent, n.depth, (SELECT count(*) FROM n c WHERE c.parent = n.path)::BIGINT AS children FROM n""")
def path_tree(spark, d):
    paths = read(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()
    return Q.path_tree(paths).select("path", "parent", F.col("depth").cast("long").alias("depth"), "children")


@query(f"""{WITH}, m AS (SELECT home AS id, id AS node FROM nodes WHERE home IS NOT NULL), s AS (SELECT id, count(*) AS n FROM m GROUP BY id), r AS (SELECT id, n, row_number() OVER (ORDER BY n DESC, id) - 1 AS spot FROM s), g AS (SELECT greatest(1, ceil(sqrt(count(*)))) AS side FROM s), p AS (SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY node) - 1 AS i FROM m)
SELECT node AS node_id, round(spot % side * 400 + greatest(40, 12 * sqrt(n)) * cos(2 * pi() * i / n), 4)::DOUBLE AS x, round(floor(spot / side) * 400 + greatest(40, 12 * sqrt(n)) * sin(2 * pi() * i / n), 4)::DOUBLE AS y FROM p JOIN r USING (id), g""")
def layout(spark, d):
    groups = _homes(graph(spark, d)).groupBy(F.col("community_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("node_ids"))
    return G.circular_layout(groups)
