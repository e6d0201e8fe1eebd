"""Work and memory that grow no faster than the tables."""

from __future__ import annotations

import datetime
import random

from weftgraph.operators import graph as G
from weftgraph.operators import lifecycle as L
from weftgraph.operators import metrics as M
from weftgraph.operators import reports as R
from weftgraph.operators import retrieval as S
from weftgraph.plans import registry
from weftgraph.session import narrow_side


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_growing_groups_equal_a_plain_loop_and_pass_in_a_stream(spark):
    rng, begin = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = [(rng.choice([None, "a", "b", "c"]), i, begin + datetime.timedelta(minutes=rng.randrange(40_000)), [rng.choice("xyz"), f"v{rng.randrange(6)}"]) for i in range(400)]
    expected, state = set(), {}
    for key, i, at, marks in sorted(rows, key=lambda r: (r[2], r[1])):
        s = state.setdefault(key, {"last": at, "stretch": 0, "groups": []})
        if at - s["last"] > datetime.timedelta(hours=24):
            s["stretch"], s["groups"] = s["stretch"] + 1, []
        s["last"], own = at, set(marks)
        for n, g in enumerate(s["groups"]):
            if at - g[0] <= datetime.timedelta(hours=24) and len(own & g[1]) / len(own | g[1]) >= 0.3:
                g[0], g[1] = at, g[1] | own
                break
        else:
            n = len(s["groups"])
            s["groups"].append([at, own])
        expected.add((key, i, s["stretch"], n))
    found = L.group_sessions(spark.createDataFrame(rows, "k string, id long, at timestamp, marks array<string>"), "k")
    assert {tuple(r) for r in found.select("k", "id", "stretch", "group_no").collect()} == expected
    assert "FlatMapGroups" not in plan(found)  # before: a call for each stretch of each key


def test_ends_of_links_are_looked_up_without_a_sort(spark):
    nodes, edges = spark.createDataFrame([("a",), ("b",), ("b",)], "id string"), spark.createDataFrame([("1", "a", "b"), ("2", "a", "x"), ("3", "x", "b"), ("4", "b", "b"), ("5", None, "b")], "id string, source string, target string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = G.prune_dangling(nodes, edges)
        assert sorted(r["id"] for r in kept.collect()) == ["1", "4"]
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        many = edges.join(narrow_side(nodes.select(nodes["id"].alias("source")).distinct(), rows=1), "source", "left_semi")
        assert "ShuffledHashJoin" in many._jdf.queryExecution().executedPlan().toString() and many.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_merged_edges_move_only_where_an_id_is_repeated(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = lambda *rows: spark.createDataFrame(list(rows), "id string, source string, target string, relation string")
    apart = G.merge({"l": G.Graph(nodes, edges(("1", "a", "b", "x"))), "r": G.Graph(nodes, edges(("1", "a", "b", "y")))}).edges
    assert sorted(tuple(r) for r in apart.collect()) == [("l:1", "l:a", "l:b", "x"), ("r:1", "r:a", "r:b", "y")] and "Window" not in plan(apart)  # before: every edge was shuffled and ranked
    met = G.merge({"l": G.Graph(nodes, edges(("r:1", "a", "b", "x"), ("2", "a", "b", "x"), (None, "a", "b", "x"))), "l:r": G.Graph(nodes, edges(("1", "a", "b", "y"), ("2", "a", "a", "z"), (None, "a", "b", "y")))}).edges
    assert sorted(((r["id"], r["relation"]) for r in met.collect()), key=str) == [("l:2", "x"), ("l:r:1", "x"), ("l:r:2", "z"), (None, "x")]


def test_community_view_counts_links_of_its_own_nodes(spark):
    nodes = spark.createDataFrame([("a", "module", "x", "p"), ("b", "module", "x", "q"), ("c", "module", "y", "p"), ("d", "symbol", "x", None)], "id string, type string, community_id string, page_id string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "c", "a"), ("4", "b", "b")], "id string, source string, target string")
    view = R.community_view(nodes, edges, "x")  # before: the caller had to count the links of all nodes
    assert sorted((r["part"], r["rank"], r["id"]) for r in view.collect()) == [("edge", 1, "1"), ("edge", 2, "2"), ("edge", 3, "4"), ("node", 1, "a"), ("node", 2, "b"), ("node", 3, "d"), ("page", 1, "p"), ("page", 2, "q")]


def test_related_outputs_gather_nothing_by_order(spark, sf_dir):
    targets = spark.createDataFrame([("p", ["n", "n"], ["s"])], "id string, node_ids array<string>, source_ids array<string>")
    outputs = spark.createDataFrame([("a", None, ["n", "n"], None), ("a", ["p"], None, None), ("b", None, None, ["s"]), ("b", None, ["n"], None), ("c", [], ["x"], ["s"])], "id string, related_page_ids array<string>, related_node_ids array<string>, related_source_ids array<string>")
    assert sorted(tuple(r) for r in S.related_outputs(targets, outputs).collect()) == [("p", "a", 3), ("p", "b", 2), ("p", "c", 1)]
    assert "collect_set" not in plan(registry.QUERIES["related_outputs"](spark, sf_dir))  # before: keys gathered by order, then taken apart again


def test_bridges_need_no_distinct_pairs(spark):
    nodes = spark.createDataFrame([(i, "source" if i == "s" else "module") for i in "sabcdefg"], "id string, type string")
    edges = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("a", "c"), ("c", "d"), ("a", "b"), ("e", "g"), ("a", "f"), ("f", "g")], "source string, target string")
    home = spark.createDataFrame([("s", "z"), ("a", "x"), ("b", "y"), ("c", "x"), ("g", "w")], "id string, community_id string")
    found = {r["id"]: r["bridge_score"] for r in M.bridge_scores(nodes, M.both_ways(edges), home).collect()}
    assert found == {r["id"]: r["bridge_score"] for r in M.bridge_scores(nodes, M.adjacency(nodes, edges), home).collect()} == {"s": 2, "a": 2, "b": 1, "c": 0, "d": 0, "e": 0, "f": 1, "g": 0}
    shuffles = M.bridge_scores(nodes, M.both_ways(edges), home)._jdf.queryExecution().executedPlan().toString()
    assert "neighbor" not in "".join(line for line in shuffles.splitlines() if "HashAggregate" in line)  # before: pairs were made distinct and moved twice more
