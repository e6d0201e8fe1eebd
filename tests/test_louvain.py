"""Communities against plain loops: modularity, contraction, splitting, sources."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import louvain as L
from weftgraph.operators import metrics as M
from weftgraph.operators.graph import Graph


def graph(spark, pairs, alone=(), sources=()):
    ids = sorted({x for p in pairs for x in p} | set(alone))
    nodes = spark.createDataFrame([(i, "source" if i in sources else "concept", f"Label {i}", None) for i in ids], "id string, type string, label string, source_ids array<string>")
    edges = spark.createDataFrame([(f"e{n:04d}", a, b) for n, (a, b) in enumerate(pairs)], "id string, source string, target string")
    return nodes, edges


def plain_modularity(links, of, resolution=1.0):
    """links: {(a, b): w}, each pair once, loops allowed."""
    m2, inner, total = 2 * sum(links.values()), defaultdict(float), defaultdict(float)
    for (a, b), w in links.items():
        total[of[a]] += w
        total[of[b]] += w
        if of[a] == of[b]:
            inner[of[a]] += 2 * w
    return sum(inner[c] / m2 - resolution * (total[c] / m2) ** 2 for c in total)


def plain_louvain(links, resolution=1.0):
    """One node after the other, level by level."""
    nodes = sorted({x for p in links for x in p})
    of = {n: n for n in nodes}
    while True:
        level = defaultdict(float)
        for (a, b), w in links.items():
            level[tuple(sorted((of[a], of[b])))] += w
        now = {n: n for n in sorted({x for p in level for x in p})}
        moved = improved = True
        while moved:
            moved = False
            for n in sorted(now):
                near = {now[b if a == n else a] for a, b in level if n in (a, b)} | {now[n]}
                best = max(sorted(near), key=lambda c: round(plain_modularity(level, now | {n: c}, resolution), 12))
                if plain_modularity(level, now | {n: best}, resolution) > plain_modularity(level, now, resolution) + 1e-9:
                    now[n], moved = best, True
        improved = len(set(now.values())) < len(now)
        of = {n: now[c] for n, c in of.items()}
        if not improved:
            return of


def cliques(draw, sizes, noise):
    names = [[f"c{k}n{i:02d}" for i in range(n)] for k, n in enumerate(sizes)]
    pairs = {p for group in names for p in itertools.combinations(group, 2)}
    flat = [x for group in names for x in group]
    while noise:
        a, b = sorted(draw.sample(flat, 2))
        if (a, b) not in pairs:
            pairs.add((a, b))
            noise -= 1
    return sorted(pairs), names


@pytest.mark.parametrize("seed", [1, 2])
def test_modularity_is_that_of_a_plain_loop(spark, seed):
    pairs, names = cliques(random.Random(seed), [7, 6, 5, 8, 4], 9)
    nodes, edges = graph(spark, pairs, alone=["zz"])
    links = L.simple_links(nodes, M.adjacency(nodes, edges))
    found = L.detect(nodes.select(F.lit("").alias("scope"), "id"), links)
    of = {r["id"]: r["community"] for r in found.members.collect()}
    weights = dict.fromkeys(pairs, 1.0)
    assert set(of) == {x for p in pairs for x in p} | {"zz"} and of["zz"] == "zz"
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(found.modularity))
    assert found.modularity[-1] == pytest.approx(plain_modularity(weights, of), abs=1e-9)
    assert found.modularity[-1] >= plain_modularity(weights, plain_louvain(weights)) - 0.02
    assert all(c == min(n for n in of if of[n] == c) for c in of.values())


def test_contraction_reaches_what_moving_alone_does_not(spark):
    """A ring of small cliques: communities of two cliques are better than of one, and only levels find them."""
    names = [[f"k{k:02d}{i}" for i in range(3)] for k in range(24)]
    pairs = sorted({p for g in names for p in itertools.combinations(g, 2)} | {tuple(sorted((names[k][0], names[(k + 1) % 24][1]))) for k in range(24)})
    nodes, edges = graph(spark, pairs)
    found = L.detect(nodes.select(F.lit("").alias("scope"), "id"), L.simple_links(nodes, M.adjacency(nodes, edges)))
    of = {r["id"]: r["community"] for r in found.members.collect()}
    assert len(found.modularity) >= 3 and len(set(of.values())) < 24
    assert found.modularity[-1] > plain_modularity(dict.fromkeys(pairs, 1.0), {x: g[0] for g in names for x in g})


def test_large_communities_are_split_and_sources_follow(spark):
    """Two cliques tied closely enough to be one community, far larger than a quarter of the nodes."""
    draw = random.Random(5)
    left, right = [f"a{i:02d}" for i in range(12)], [f"b{i:02d}" for i in range(12)]
    pairs = [*itertools.combinations(left, 2), *itertools.combinations(right, 2), *{(draw.choice(left), draw.choice(right)) for _ in range(10)}, ("s1", "b03"), ("s1", "a04"), ("s2", "s1")]
    nodes, edges = graph(spark, pairs, sources=("s1", "s2"))
    near = M.adjacency(nodes, edges)
    one = L.detect(nodes.where("type <> 'source'").select(F.lit("").alias("scope"), "id"), L.simple_links(nodes, near), resolution=0.05).members
    assert one.select("community").distinct().count() == 1
    links = L.simple_links(nodes, near)
    members, apart = L._split(one.select("id", "community"), links, one.select("community").distinct(), 1.0)
    of = {r["id"]: r["community"] for r in members.collect()}
    assert apart and {of[x] for x in left} == {"a00"} and {of[x] for x in right} == {"b00"}
    placed = {r["id"]: r["community"] for r in L.with_sources(nodes, edges, members).collect()}
    assert placed["s1"] == "b00" and "s2" not in placed  # the first edge of s1 goes to b03; s2 has no neighbour with a community


def test_no_community_that_can_be_split_stays_too_large(spark):
    pairs, _ = cliques(random.Random(8), [14, 13, 12], 60)
    nodes, edges = graph(spark, pairs)
    near = M.adjacency(nodes, edges)
    members = L.communities(nodes, near, resolution=0.3).members
    links, most = L.simple_links(nodes, near), max(L.LEAST, 39 // 4)
    for r in members.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") > most).collect():
        inside = members.where(F.col("community") == r["community"]).select("id")
        own = links.join(inside.withColumnRenamed("id", "a"), "a", "left_semi").join(inside.withColumnRenamed("id", "b"), "b", "left_semi")
        assert L.detect(inside.select(F.lit("").alias("scope"), "id"), own, 0.3).members.select("community").distinct().count() == 1


def test_refresh_makes_metrics_anew(spark):
    pairs, names = cliques(random.Random(2), [9, 8, 7, 6], 3)
    nodes, edges = graph(spark, [*pairs, ("s", "c0n00")], sources=("s",))
    edges = edges.unionByName(spark.createDataFrame([("bad", "c0n00", "nowhere")], edges.schema))
    hyper = spark.createDataFrame([("h1", ["c0n00", "c1n00"]), ("h2", ["c0n00", "nowhere"])], "id string, node_ids array<string>")
    old = nodes.withColumn("community_id", F.lit("old")).withColumn("degree", F.lit(99))
    g = L.refresh_clusters(Graph(old, edges, hyper), resolution=1.0)
    rows = {r["id"]: r for r in g.nodes.collect()}
    assert [r["id"] for r in g.hyperedges.collect()] == ["h1"] and g.edges.where("id = 'bad'").count() == 0
    groups = {rows[n]["community_id"] for n in names[0]}
    assert groups == {"community:label-c0n00-1"} and rows["s"]["community_id"] == "community:label-c0n00-1"
    assert rows["s"]["degree"] == 1 and rows["s"]["bridge_score"] == 1
    assert all((r["reason"] or "").startswith(f"degree {r['degree']}") for r in rows.values() if r["is_god"]) and any(r["is_god"] for r in rows.values())
    assert [r["size"] for r in g.communities.orderBy(F.desc("size")).collect()] == [9, 8, 7, 6]


def test_no_nodes_and_no_links(spark):
    nodes, edges = graph(spark, [], alone=[])
    assert L.communities(nodes, M.adjacency(nodes, edges)).members.count() == 0
    nodes, edges = graph(spark, [], alone=["a", "b"])
    assert sorted(tuple(r) for r in L.communities(nodes, M.adjacency(nodes, edges)).members.collect()) == [("a", "a"), ("b", "b")]


def test_rounds_shuffle_no_links(spark):
    """Ranks follow names, and links in buckets are grouped by their first end without an exchange."""
    ids = spark.createDataFrame([("b",), ("a",), ("d",), ("c",)], "id string").repartition(3)
    assert {r["id"]: r["rank"] for r in L._ranked(ids).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    links = L._bucketed(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "a long, b long, w double"))
    ends = spark.createDataFrame([(k, k % 2) for k in range(4)], "b long, to long")
    ties = links.join(F.broadcast(ends), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
    assert "Exchange hashpartitioning" not in ties._jdf.queryExecution().executedPlan().toString() and ties.count() == 4


def test_blocks_of_arrays_give_what_joins_give(spark, monkeypatch):
    """Two scopes, contracted levels and a node alone: rounds over blocks name the same communities as rounds of joins, in the same steps."""
    draw = random.Random(11)
    pairs = {tuple(sorted(draw.sample(range(at, at + 12), 2))) for at in (0, 12, 30, 42) for _ in range(40)} | {tuple(sorted(draw.sample(range(at, at + 24), 2))) for at in (0, 30) for _ in range(8)}
    links = spark.createDataFrame([(*p, 1.0) for a, b in sorted(pairs) for p in ((a, b), (b, a))], "a long, b long, w double")
    ids = spark.createDataFrame([("x" if i < 25 else "y", i) for i in range(56)], "scope string, id long")
    monkeypatch.setattr(L, "BLOCK_LINKS", 100)
    assert L._blocks(links, np.ones(56), np.ones(56)).count() > 1
    found, joined = L.detect(ids, links, 1.0, 4, 2, ranked=56), L._detect_joined(ids, links, 1.0, 4, 2)
    rows = lambda df: sorted(tuple(r) for r in df.members.select("scope", "id", "community").collect())
    assert rows(found) == rows(joined) and len(rows(found)) == 56
    assert found.modularity == pytest.approx(joined.modularity, abs=1e-9)


def test_movers_are_drawn_by_the_same_hash(spark):
    at = np.array([0, 1, 77, 2**31, 2**40 + 5])
    want = [r[0] % 2**64 for r in spark.createDataFrame([(int(x),) for x in at], "n long").select(F.xxhash64("n", F.lit(2_003))).collect()]
    assert L._hashed(at, 2_003).tolist() == want


def test_adjacency_is_distinct_both_ways(spark):
    """Loops once, pairs that come both ways once each way, ends that are null as they are."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("c", None), (None, "c"), ("b", "d"), ("b", "d")], "source string, target string")
    found = sorted((tuple(r) for r in M.adjacency(edges, edges).collect()), key=str)
    assert found == sorted([("a", "b"), ("b", "a"), ("a", "a"), ("c", None), (None, "c"), ("b", "d"), ("d", "b")], key=str)


def test_modularity_sends_few_members_to_the_links(spark):
    """Members of communities go to all tasks, so links are not sorted by either end."""
    near = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "id string, neighbor string")
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "c")], "id string, community_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = M.modularity(near, members)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.first()[0] == pytest.approx(2 / 4 - (3 * 3 + 1) / 16)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
