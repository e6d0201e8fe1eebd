"""Many questions at once against a plain walk of each."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import walks as W
from weftgraph.operators.graph import Graph


def made(spark, seed, n=60, m=220):
    draw = random.Random(seed)
    words = ["red", "blue", "green", "door", "lamp", "xylophone"]
    nodes = [(f"n{i:02d}", " ".join(draw.sample(words, draw.randint(1, 3))) + draw.choice(["", f" {i}"]), draw.choice(["concept", "source"]), draw.choice([None, "p1", "p2", "p3"]), draw.choice([None, "c1", "c2"])) for i in range(n)]
    edges = []
    for k in range(m):
        a = draw.choice([0, 1, draw.randrange(n)])  # two hubs
        edges.append((f"e{k:03d}", f"n{a:02d}", f"n{draw.randrange(n):02d}", draw.choice(["mentions", "defines"]), "extracted", draw.choice([1.0, 0.9, 0.5])))
    edges += [(f"p{k}", "n00", "n05", "mentions", "extracted", 1.0) for k in range(5)]  # parallel ones
    pages = [("p1", "Red door page", "a/red.md", "concept"), ("p2", "Lamps", "b/lamp", "source"), ("p9", "red", "c", "source")]
    hyper = [("h1", "blue group", "participate_in", ["n03", "n04", "n00"], None), ("h2", "other", "form", ["n01"], "because of green things")]
    g = Graph(
        spark.createDataFrame(nodes, "id string, label string, type string, page_id string, community_id string"), spark.createDataFrame(edges, "id string, source string, target string, relation string, evidence_class string, confidence double"),
        spark.createDataFrame(hyper, "id string, label string, relation string, node_ids array<string>, why string"), None, spark.createDataFrame(pages, "id string, title string, path string, kind string"),
    )
    return g, nodes, edges, pages, hyper


def score(q, c):
    q, c = " ".join((q or "").lower().split()), " ".join((c or "").lower().split())
    if not q or not c:
        return 0
    return 100 if q == c else 80 if c.startswith(q) else 60 if q in c else 10 * sum(w in c.split(" ") for w in q.split(" "))


def plain(question, nodes, edges, pages, hyper, budget, depth_first):
    found = [(-max(score(question, t), score(question, p)), t, 0, i) for i, t, p, _ in pages]
    found += [(-max(score(question, label), score(question, i)), label, 1, i) for i, label, *_ in nodes]
    found += [(-max(score(question, label), score(question, why), score(question, r)), label, 2, i) for i, label, r, _, why in hyper]
    found = sorted(f for f in found if f[0] < 0)[:12]
    starts = [n[0] for f in found if f[2] == 0 for n in nodes if n[3] == f[3]] + [f[3] for f in found if f[2] == 1] + [x for f in found if f[2] == 2 for h in hyper if h[0] == f[3] for x in h[3]]
    starts = list(dict.fromkeys(starts))
    near = defaultdict(list)
    for i, a, b, r, _, c in edges:
        near[a].append((-c, r, i, b))
        near[b].append((-c, r, i, a))
    queue, visited, seen_edges = list(starts), [], {}
    while queue and len(visited) < budget:
        now = queue.pop() if depth_first else queue.pop(0)
        if now in visited:
            continue
        visited.append(now)
        for _, _, i, b in sorted(near[now]):
            seen_edges[i] = None
            if b not in visited:
                queue.append(b)
            if len(visited) + len(queue) >= 2 * budget:
                break
    by = {n[0]: n for n in nodes}
    of_page = list(dict.fromkeys([f[3] for f in found if f[2] == 0] + [by[v][3] for v in visited if by[v][3]]))
    groups = list(dict.fromkeys(by[v][4] for v in visited if by[v][4]))
    return starts, visited, sorted(seen_edges), of_page, groups, sorted(h[0] for h in hyper if set(h[3]) & set(visited))


ASKED = ["red door", "Blue  group", "lamp", "xylo", "n07", "nothing like it", "", None, "green things", "re", "x", "door door lamp"]


@pytest.mark.parametrize(("depth_first", "budget"), [(False, 12), (True, 12), (False, 3), (True, 3), (True, 50), (False, 99)])
def test_walks_equal_a_plain_loop(spark, depth_first, budget):
    g, nodes, edges, pages, hyper = made(spark, budget)
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, text string")
    got = {r["query_id"]: r for r in W.ask(g, asked, budget, depth_first).collect()}
    for k, question in enumerate(ASKED):
        r = got[k]
        starts, *want = plain(question, nodes, edges, pages, hyper, max(3, min(50, budget)), depth_first)
        assert [list(r["visited"]), sorted(r["edges"]), list(r["pages"]), list(r["communities"]), sorted(r["hyperedges"])] == want, question
        if budget > 3:  # else not all seeds of a page are kept
            assert list(r["seeds"]) == starts


def test_context_lines_and_tokens(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "concept", "p"), ("b", "Beta", "source", None)], "id string, label string, type string, page_id string")
    edges = spark.createDataFrame([("e", "a", "b", "mentions", "extracted", 0.5)], "id string, source string, target string, relation string, evidence_class string, confidence double")
    g = Graph(nodes, edges, pages=spark.createDataFrame([("p", "Page", "x.md", "concept")], "id string, title string, path string, kind string"))
    went = W.ask(g, spark.createDataFrame([(1, "alpha"), (2, "none")], "query_id int, text string"))
    told = {r["query_id"]: r for r in W.context(g, went, spark.createDataFrame([("p", "Some   body " * 100)], "id string, body string")).collect()}
    assert told[1]["lines"].split("\n") == ["PAGE Page path=x.md kind=concept", "PAGE_BODY " + ("Some body " * 100)[:280], "NODE Alpha type=concept community=unassigned page=p", "NODE Beta type=source community=unassigned page=none", "EDGE Alpha --mentions/extracted/0.50--> Beta"]
    assert told[1]["tokens"] == -(-sum(len(x) for x in told[1]["lines"].split("\n")) // 4) and told[2]["lines"] == "" and told[2]["tokens"] == 0


def test_hubs_keep_what_a_walk_can_see(spark):
    """A hub of 3,000 edges: what is kept of it is bounded, and is its best."""
    rows = [(f"e{k:04d}", "hub", f"x{k:04d}", "mentions", "extracted", 1.0 if k % 100 == 7 else 0.1) for k in range(3_000)]
    edges = spark.createDataFrame(rows, "id string, source string, target string, relation string, evidence_class string, confidence double")
    hub = W.neighbours(edges, 5).where(F.col("id") == "hub").first()["near"]
    assert len(hub) == 15 and [x["neighbor"] for x in hub] == [f"x{k:04d}" for k in range(7, 1_500, 100)]


def test_matches_meet_as_distinct_texts(spark, tmp_path):
    """400 questions of two texts and 400 nodes of three names: rows made grow with the distinct texts, not with questions times nodes."""
    names = ["red door", "red lamp", "blue"]
    nodes = [(f"n{i:03d}", names[i % 3]) for i in range(400)]
    g = Graph(spark.createDataFrame(nodes, "id string, label string"), spark.createDataFrame([], "id string, source string, target string, relation string, confidence double"))
    asked = spark.createDataFrame([(k, ["red  Door", "lamp n399"][k % 2]) for k in range(400)], "query_id int, text string")
    made = []
    kept, W.written = W.written, lambda df, label: made.append((label, kept(df, label))) or made[-1][1]
    try:
        got = [tuple(r) for r in W.matches(g, asked).orderBy("query_id", "rank").collect()]
    finally:
        W.written = kept
    want = []
    for k in range(400):
        q = ["red door", "lamp n399"][k % 2]
        found = sorted((-max(score(q, label), score(q, i)), label, i) for i, label in nodes)
        want += [(k, n + 1, "node", i, label, -s) for n, (s, label, i) in enumerate([f for f in found if f[0] < 0][:12])]
    assert got == want
    assert dict(made)["met"].count() == 4


def test_questions_of_one_text_share_a_walk(spark):
    """Ninety questions of three texts: three states are walked, and only the nodes that they wait for are looked up."""
    g, nodes, edges, pages, hyper = made(spark, 4)
    texts = ["red door", "Red   DOOR ", "lamp", None]
    asked = spark.createDataFrame([(k, texts[k % 4]) for k in range(90)], "query_id int, text string")
    sizes, looked = [], []
    kept, found = W.written, W.neighbours
    W.written = lambda df, label: (made_ := kept(df, label), sizes.append((label, made_.count())))[0]
    W.neighbours = lambda edges, budget, of=None: (looked.append(of is not None and of.count()), found(edges, budget, of))[1]
    try:
        got = {r["query_id"]: r for r in W.ask(g, asked).collect()}
    finally:
        W.written, W.neighbours = kept, found
    assert sorted(got) == list(range(90)) and max(n for label, n in sizes if label == "walks") == 3
    assert all(0 < n <= 24 for n in looked[1:]) and len(looked) > 1
    for k in range(90):
        starts, *want = plain(texts[k % 4], nodes, edges, pages, hyper, 12, False)
        assert [list(got[k]["visited"]), sorted(got[k]["edges"]), list(got[k]["pages"]), list(got[k]["communities"]), sorted(got[k]["hyperedges"])] == want
