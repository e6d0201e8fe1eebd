from __future__ import annotations

import pytest

import datetime as dt
import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftgraph.functions.scoring import SIMILARITY_WEIGHTS
from weftgraph.operators import analysis as A
from weftgraph.operators import graph as G
from weftgraph.operators import lifecycle as L
from weftgraph.operators import metrics as M
from weftgraph.operators import pack as P
from weftgraph.operators import retrieval as R
from weftgraph.operators import traverse as Q
from weftgraph.sources import files as SF
from weftgraph.sources import messages as SM
from weftgraph.sources import structured as SS
from weftgraph.streaming import refresh as X

NODE = "id string, type string, label string, source_class string, page_id string, language string, source_ids array<string>"
EDGE = "id string, source string, target string, relation string, evidence_class string, confidence double"


def small(spark):
    nodes = spark.createDataFrame(
        [("concept:auth", "concept", "Auth", None, "p1", None, ["a", "b"]), ("source:auth", "source", "auth", "first_party", "p2", None, ["a"]), ("module:auth", "module", "auth.ts", "first_party", "p3", "typescript", ["a"]), ("source:brief", "source", "briefing", "third_party", "p4", None, ["b"])], NODE
    )
    edges = spark.createDataFrame([("e1", "source:auth", "module:auth", "contains_code", "extracted", 1.0), ("e2", "source:brief", "concept:auth", "mentions", "extracted", 1.0), ("e3", "module:auth", "concept:auth", "mentions", "inferred", 0.6)], EDGE)
    return G.Graph(nodes, edges)


def test_set_join_makes_no_pairs_of_sets_that_must_differ(spark):
    """Sixty sets of one word: only those of other source and polarity are paired, before their items are fetched."""
    said = spark.createDataFrame([(k, k // 2, "positive" if k % 20 else "negative", ["w", f"x{k}"]) for k in range(60)], "id int, source int, polarity string, items array<string>")
    found = A.set_join(said, 0.02, apart=("source", "polarity"))
    rows = {k: (k // 2, bool(k % 20)) for k in range(60)}
    want = {(a, b) for a in rows for b in rows if a < b and rows[a][0] != rows[b][0] and rows[a][1] != rows[b][1]}
    assert {(r["left_id"], r["right_id"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    deepest = [line for line in plan.splitlines() if "Join Inner" in line and "item" in line and "polarity" in line]
    assert deepest, plan


def test_reach_keeps_only_ends_of_edges(spark, monkeypatch):
    """What is stored for the steps is source and target; a small frontier is broadcast."""
    stored, bounded = [], []
    kept, bound = type(spark.range(0)).checkpoint, Q.bounded_broadcast
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda df, *a: (stored.append(df.columns), kept(df, *a))[1])
    monkeypatch.setattr(Q, "bounded_broadcast", lambda df: (bounded.append(df.count()), bound(df))[1])
    rows = sorted(tuple(r) for r in Q.reach(small(spark).edges, "source:auth", 3).collect())
    assert rows == [("concept:auth", 2, "module:auth"), ("module:auth", 1, "source:auth"), ("source:auth", 0, None), ("source:brief", 3, "concept:auth")]
    assert stored[0] == ["source", "target"] and bounded == [1, 1, 1]


def test_path_and_reach(spark):
    g = small(spark)
    assert Q.shortest_path(g.edges, "concept:auth", "source:brief") == ["concept:auth", "source:brief"]
    assert Q.shortest_path(g.edges, "source:auth", "nowhere") == []
    assert {r["id"]: r["depth"] for r in Q.reach(g.edges, "source:auth", 5).collect()} == {"source:auth": 0, "module:auth": 1, "concept:auth": 2, "source:brief": 3}
    assert Q.resolve(g.nodes, "module:auth").first()["id"] == "module:auth"
    assert [r["id"] for r in Q.query(g.nodes, g.edges, "auth", 3).collect()][0] == "concept:auth"


def test_filters_and_validation(spark):
    g = small(spark)
    f = G.filter_for_query(g, relation_groups=("imports",), evidence=("extracted",), languages=("typescript",))
    assert [r["id"] for r in f.edges.collect()] == ["e1"] and {r["id"] for r in f.nodes.collect()} == {"source:auth", "module:auth"}
    assert G.validate(g).count() == 0
    broken = G.Graph(g.nodes.unionByName(g.nodes.limit(1)), g.edges.unionByName(spark.createDataFrame([("e9", "source:auth", "none", "mentions", "extracted", 1.2)], EDGE)))
    assert {r["code"] for r in G.validate(broken).collect()} == {"duplicate_node_id", "dangling_edge_target", "invalid_confidence"}
    left = G.without_sources(g, spark.createDataFrame([("a",)], "source_id string"))
    assert {r["id"] for r in left.nodes.collect()} == {"concept:auth", "source:brief"} and [r["id"] for r in left.edges.collect()] == ["e2"]


def test_hubs_need_two_members(spark):
    g = small(spark)
    hyper = spark.createDataFrame([("h1", "t", "form", ["module:auth", "concept:auth", "gone"], "inferred", 0.7), ("h2", "t", "form", ["module:auth", "gone"], "inferred", 0.7)], "id string, label string, relation string, node_ids array<string>, evidence_class string, confidence double")
    nodes, edges = G.hubs(G.Graph(g.nodes, g.edges, hyper))
    assert [r["id"] for r in nodes.collect()] == ["hyper:h1"] and edges.count() == 2
    assert G.of_classes(G.Graph(g.nodes, g.edges, hyper), ["first_party"]).hyperedges.count() == 0


def test_communities_are_a_partition_better_than_singletons(spark):
    links = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    edges = spark.createDataFrame([(f"e{n}", s, t, "r", "extracted", 1.0) for n, (s, t) in enumerate(links)], EDGE)
    nodes = spark.createDataFrame([(f"{c}{i}", "concept") for c in "ab" for i in range(5)] + [("alone", "concept")], "id string, type string")
    near = M.adjacency(nodes, edges)
    found = M.communities(nodes, near)
    of = {r["id"]: r["community_id"] for r in found.collect()}
    assert len(of) == 11 and of["alone"] == "alone"
    assert len({of[f"a{i}"] for i in range(5)}) == 1 and len({of[f"b{i}"] for i in range(5)}) == 1 and of["a1"] != of["b1"]
    singles = nodes.select("id", F.col("id").alias("community_id"))
    assert M.modularity(near, found).first()[0] > 0.3 > M.modularity(near, singles).first()[0]


def test_god_nodes_of_a_star(spark):
    nodes = spark.createDataFrame([(f"n{i}", "concept") for i in range(12)], "id string, type string")
    edges = spark.createDataFrame([(f"e{i}", "n0", f"n{i}", "r", "extracted", 1.0) for i in range(1, 12)], EDGE)
    top = M.god_nodes(M.degrees(nodes, M.adjacency(nodes, edges))).where("is_god").collect()
    assert [(r["id"], r["degree"]) for r in top] == [("n0", 11)] and top[0]["sigma"] > 3


def test_set_join_matches_nested_loops(spark):
    import random

    rng = random.Random(5)
    sets = [(i, [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 7))]) for i in range(60)]
    got = {(r[0], r[1]) for r in A.set_join(spark.createDataFrame(sets, "id int, items array<string>"), 0.5).collect()}
    want = {(i, j) for i, a in sets for j, b in sets if i < j and set(a) | set(b) and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5}
    assert got == want


def test_contradictions_and_similarity(spark):
    said = spark.createDataFrame([(1, "a", "The cache is always enabled here", "positive"), (2, "b", "The cache is never enabled here", "negative"), (3, "a", "Cache never enabled here", "negative")], "id int, source string, claim string, polarity string")
    assert [(r[0], r[1]) for r in A.contradictions(said).collect()] == [(1, 2)]
    feats = [("l", "source", "shared_concept", "rare"), ("r", "source", "shared_concept", "rare")] + [(f"x{i}", "source", "shared_concept", "common") for i in range(8)]
    features = spark.createDataFrame(feats, "id string, type string, reason string, value string")
    scopes = spark.createDataFrame([(f[0], None, [f[0]]) for f in feats], "id string, page_id string, source_ids array<string>")
    got = {(r["a"], r["b"]): r["confidence"] for r in A.similarity_edges(features, scopes).collect()}
    assert got[("l", "r")] > got[("x0", "x1")]
    assert A.similarity_edges(features, scopes, floor=10).count() == 0


def test_sessions_grow_and_split(spark):
    day = dt.datetime(2026, 4, 16)
    first = [("u", f"a{i}", day + dt.timedelta(hours=i), ["c1", "c2"]) for i in range(3)]
    second = [("u", f"b{i}", day + dt.timedelta(hours=10 + i), ["d1", "d2"]) for i in range(3)]
    late = [("u", "z", day + dt.timedelta(days=9), ["c1"])]
    groups = L.group_sessions(spark.createDataFrame(first + second + late, "k string, id string, at timestamp, marks array<string>"), "k")
    packs = L.episodes(groups, "k").collect()
    assert sorted(tuple(r["ids"]) for r in packs) == [("a0", "a1", "a2"), ("b0", "b1", "b2")] and packs[0]["confidence"] == 0.7


def test_workflows_promotion_lint(spark):
    titles = spark.createDataFrame([(i, t) for i, t in enumerate(["Deploy service A", "Deploy service B", "How to deploy C", "Other"])], "id int, title string")
    assert [(r["verb"], r["pages"]) for r in L.workflows(titles).collect()] == [("deploy", 3)]
    cand = spark.createDataFrame([("x", ["a", "b", "c"], ["a", "b", "c"], 0.9, 3, 30.0), ("y", ["a"], None, 0.9, 3, None)], "id string, source_ids array<string>, previous_ids array<string>, confidence double, degree int, age_hours double")
    assert [(r["id"], r["passed"], r["promote"]) for r in L.promotion(cand).collect()] == [("x", 5, True), ("y", 2, False)]
    pages = spark.createDataFrame([("p", "concept", "fresh", 0.1, None, [], {"s": "old"}), ("q", "source", "stale", 0.0, "gone", ["p"], {"s": "new"})], "id string, kind string, freshness string, decay_score double, superseded_by string, backlinks array<string>, source_hashes map<string,string>")
    found = {(r["code"], r["id"]) for r in L.lint_pages(pages, spark.createDataFrame([("s", "new")], "source_id string, hash string")).collect()}
    assert found == {("stale_page", "p"), ("orphan_page", "p"), ("broken_supersession", "q"), ("inconsistent_decay", "p")}
    blocked = G.shrink_guard(spark.range(12), spark.range(8)).first()
    assert blocked["blocked"] and blocked["drop_ratio"] > 0.25


def test_fit_skips_and_goes_on(spark):
    items = spark.createDataFrame([("a", 100.0, "a", 6), ("b", 90.0, "b", 7), ("c", 80.0, "c", 3)], "id string, score double, title string, tokens int")
    assert {r["id"]: r["included"] for r in P.fit(items, 10).collect()} == {"a": True, "b": False, "c": True}


def test_fit_equals_plain_loop_in_groups(spark):
    draw = random.Random(5)
    rows = [(f"i{n:04d}", draw.choice(["hot", "hot", "cold", None]), float(draw.randrange(9)), f"t{draw.randrange(50)}", draw.choice([0, 1, 2, 3, 7, 20, 21, 40, 90, None])) for n in range(600)]
    expected = set()
    for group in ("hot", "cold", None):
        used = 13
        for row in sorted((r for r in rows if r[1] == group), key=lambda r: (-r[2], r[3], r[0])):
            if row[4] is not None and used + row[4] <= 100:
                used += row[4]
                expected.add(row[0])
    items = spark.createDataFrame(rows, "id string, kind string, score double, title string, tokens int")
    assert {r["id"] for r in P.fit(items, 100, 13, "kind").where("included").collect()} == expected
    assert P.fit(items, 100, 13, "kind").count() == len(rows)
    assert P.fit(items, 5, 6).where("included").isEmpty() and P.fit(items.limit(0), 5).isEmpty()


def test_full_text_equals_plain_cut(spark):
    draw = random.Random(6)
    rows = [(n, f"p{draw.randrange(90):03d}", draw.choice(["", "ab", "c" * 17, None])) for n in range(300)]
    pages = spark.createDataFrame(rows, "id long, path string, text string").repartition(7)
    for cap in (0, 1, 500, 10_000):
        before, expected = 0, {}
        for n, _, text in sorted(rows, key=lambda r: (r[1], r[0])):
            if before < cap:
                expected[n] = None if text is None else text[: cap - before]
            before += len(text or "")
        assert {r["id"]: r["text"] for r in P.full_text(pages, cap).collect()} == expected


def test_similarity_edges_equal_all_pairs(spark):
    draw = random.Random(7)
    reasons = {"shared_concept": 30, "shared_source_type": 2, "shared_tag": 12}
    rows = [(n, "t", reason, f"v{min(draw.randrange(top), draw.randrange(top))}") for n in range(60) for reason, top in reasons.items() for _ in range(4)]
    features = spark.createDataFrame(rows, "id long, type string, reason string, value string")
    scopes = spark.createDataFrame([(n, f"p{n}", [str(n)]) for n in range(60)], "id long, page_id string, source_ids array<string>")
    has = {n: sorted({(r[2], r[3]) for r in rows if r[0] == n}) for n in range(60)}
    df = Counter(f for own in has.values() for f in own)
    expected = {}
    for a, b in itertools.combinations(range(60), 2):
        parts = {}
        for reason, value in has[a]:
            idf = math.log(61 / (df[reason, value] + 1)) + 1
            if (reason, value) in has[b] and idf >= 0.5:
                weight = SIMILARITY_WEIGHTS.get(reason, 0.1)
                parts[reason] = parts[reason] + min(0.12, 0.04 * idf) if reason in parts else min(2 * weight, weight * idf)
        score = min(0.96, sum(parts.values()) + {0: 0, 1: 0, 2: 0.04}.get(len(parts), 0.08))
        if score >= 0.5:
            expected[a, b] = round(score, 9)
    assert expected and len(expected) < 1_770
    assert {(r["a"], r["b"]): round(r["confidence"], 9) for r in A.similarity_edges(features, scopes).collect()} == expected
    best = sorted(expected, key=lambda p: (-expected[p], p))
    assert [(r["a"], r["b"]) for r in A.similarity_edges(features, scopes, limit=20).collect()] == best[:20]


def test_similarity_edges_stop_with_the_best(spark):
    features = spark.range(600).selectExpr("id", "'t' as type", "explode(array(concat('u', id % 40), concat('w', id % 8), concat('v', id % 20))) as value", "'shared_concept' as reason")
    scopes = spark.range(600).selectExpr("id", "cast(id as string) as page_id", "array(cast(id as string)) as source_ids")
    rank = lambda rows: sorted((-round(r["confidence"], 9), r["a"], r["b"]) for r in rows)
    every = rank(A.similarity_edges(features, scopes).collect())
    for limit in (50, 3_000, len(every) + 1):
        assert rank(A.similarity_edges(features, scopes, limit=limit).collect()) == every[:limit]


def test_search_and_fusion(spark):
    pages = spark.createDataFrame([(1, "repairable retrieval index"), (2, "another page"), (3, None)], "doc_id int, text string")
    assert [r["doc_id"] for r in R.search(pages, "Repairable retrieval").collect()] == [1]
    assert R.search(pages, "!!").collect() == []
    ranks = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    other = spark.createDataFrame([(2, 1), (1, 2)], "id int, rank int")
    scores = {r["id"]: round(r["score"], 9) for r in R.fuse([ranks, other], "id").collect()}
    assert scores[1] == scores[2]


def test_sources(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\nHello <b>there</b>\n\n01:00:03,000 --> 01:00:04,000\nSecond\nline"
    rows = SM.cues(spark.createDataFrame([("t", vtt)], "id string, text string")).orderBy("at").collect()
    assert [(r["start_ms"], r["end_ms"], r["said"]) for r in rows] == [(1000, 2500, "Hello there"), (3_603_000, 3_604_000, "Second line")]
    ics = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:Long\n  title\nDTSTART:20240102T030405Z\nORGANIZER:mailto:a@b.c\nEND:VEVENT\nEND:VCALENDAR"
    event = SM.events(spark.createDataFrame([("c", ics)], "id string, text string")).first()
    assert event["title"] == "Long title" and event["starts"] == dt.datetime(2024, 1, 2, 3, 4, 5) and event["organizer"] == "a@b.c"
    raw = "From: A <a@x.org>\nTo: b@x.org\nSubject: Hi\nMessage-ID: <1@x>\n\nBody"
    mail = SM.mails(spark.createDataFrame([(1, raw)], "id int, raw string")).first()
    assert mail["participants"] == ["a@x.org", "b@x.org"] and mail["subject"] == "Hi" and mail["conversation"] == "<1@x>"
    cells = spark.createDataFrame([("t", 0, ["name", "age"]), ("t", 1, ["x", "1"]), ("u", 0, ["1", "2"]), ("u", 1, ["3", "4"])], "id string, at int, cells array<string>")
    assert {r["id"]: r["names"] for r in SS.header_names(cells).collect()} == {"t": ["name", "age"], "u": ["column_1", "column_2"]}
    shapes = SS.json_shapes(spark.createDataFrame([(1, '{"a": [1, {"b": 2}]}'), (2, "no")], "id int, text string")).orderBy("id").collect()
    assert [(r["kind"], r["size"], r["depth"]) for r in shapes] == [("object", 1, 3), ("invalid", 0, 0)]
    book = '{"cells": [{"cell_type": "code", "source": ["x = 1"], "outputs": [{"text": ["1"]}]}, {"cell_type": "markdown", "source": ["# T"]}]}'
    assert [(r["kind"], r["source"], r["output"]) for r in SS.notebook_cells(spark.createDataFrame([(1, book)], "id int, text string")).collect()] == [("code", "x = 1", "1"), ("markdown", "# T", "")]
    code = SS.code_symbols(spark.createDataFrame([("a.py", "import os\nclass A:\n    def f(self): ...\n"), ("b.py", "(")], "path string, text string")).collect()
    assert [(r["kind"], r["name"]) for r in code] == [("import", "os"), ("class", "A"), ("function", "f")]
    sql = SS.sql_lineage(spark.createDataFrame([("q.sql", "CREATE VIEW v AS SELECT * FROM a JOIN b ON 1=1 -- FROM no")], "path string, text string")).collect()
    assert {(r["relation"], r["object"]) for r in sql} == {("defines", "v"), ("reads", "a"), ("joins", "b")}


def test_file_scan(spark, tmp_path):
    for name in ("src/a.py", "src/b.md", "node_modules/c.js", "x.bin", ".git/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {r["path"]: (r["kind"], r["language"], r["reason"]) for r in SF.scan(spark, str(tmp_path)).collect()}
    assert found["src/a.py"] == ("code", "python", None) and found["src/b.md"] == ("markdown", None, None)
    assert found["node_modules/c.js"][2] == "source_class" and found["x.bin"][2] == "unsupported" and ".git/d.py" not in found  # Spark reads no hidden folders
    assert SF.decide(spark.createDataFrame([(".git/d.py",)], "path string")).first()["reason"] == "ignored"
    assert SF.decide(spark.createDataFrame([("a.py",), ("b.py",)], "path string"), most=1).where("reason = 'max_files'").count() == 1


def test_stream_cycle_and_groups(spark, tmp_path):
    rows = [("a.py", dt.datetime(2024, 1, 1), "add"), ("a.py", dt.datetime(2024, 1, 2), "change"), ("n.md", dt.datetime(2024, 1, 1), "add")]
    spark.createDataFrame(rows, "path string, at timestamp, reason string").write.parquet(str(tmp_path / "in"))
    seen = []
    X.watch(spark, str(tmp_path / "in"), "path string, at timestamp, reason string", lambda b, n: seen.extend(X.latest_pending(None, b.where("not is_code")).collect()), str(tmp_path / "cp")).awaitTermination()
    assert [r["path"] for r in seen] == ["n.md"]
    latest = X.latest_pending(spark.createDataFrame(rows[:1], "path string, at timestamp, reason string"), spark.createDataFrame(rows[1:], "path string, at timestamp, reason string"))
    assert {r["path"]: r["reason"] for r in latest.collect()} == {"a.py": "change", "n.md": "add"}


def test_import_and_call_resolution(spark):
    imports = spark.createDataFrame([("m", "pkg.a"), ("m", "twice"), ("m", "os")], "id string, name string")
    aliases = spark.createDataFrame([("pkg.a", "module:a"), ("twice", "module:x"), ("twice", "module:y")], "name string, target string")
    assert {r["name"]: r["external"] for r in A.resolve_imports(imports, aliases).collect()} == {"pkg.a": False, "twice": True, "os": True}
    calls = spark.createDataFrame([("m", "m.f", "g"), ("m", "m.f", "h"), ("m", "m.f", "f")], "module string, caller string, name string")
    local = spark.createDataFrame([("m", "g", "m.g"), ("m", "f", "m.f")], "module string, name string, symbol string")
    far = spark.createDataFrame([("m", "h", "n.h"), ("m", "g", "n.g")], "module string, name string, symbol string")
    assert {(r["target"], r["confidence"]) for r in A.resolve_calls(calls, local, far).collect()} == {("m.g", 1.0), ("n.h", 0.8)}


def test_embedding_edges_at_every_size(spark):
    """More vectors than any earlier bound, against all pairs by numpy; with zero, null and shorter vectors."""
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(300, 8))[rng.integers(0, 300, 3000)] + 0.15 * rng.normal(size=(3000, 8))).astype(np.float32)
    v[10:14] = v[10]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, [0.0] * 8), (9002, None), (9003, v[0, :5].tolist()), (9004, [])]
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = {}
    for a in range(len(v)):
        c = unit[a + 1 :] @ unit[a]
        near = np.flatnonzero(c >= 0.82)
        for k in sorted(near.tolist(), key=lambda k: (-round(float(c[k]), 12), k))[:3]:
            want[(a, a + 1 + k)] = round(float(c[k]), 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (32_768, 300):
        got = {(r["a"], r["b"]): r["confidence"] for r in R.embedding_edges(df, block=block).collect()}
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.0011 for k in want)


def test_set_join_moves_no_pairs(spark):
    """Pairs that share many items come once, and are neither made distinct nor joined with their items again."""
    import itertools
    import random

    draw = random.Random(3)
    sets = {i: draw.sample("abcdefghijklmnop", draw.randint(1, 9)) for i in range(60)}
    rows = spark.createDataFrame([(i, i % 3, x) for i, x in sets.items()], "id int, side int, items array<string>")
    for least in (0.02, 0.3, 1.0):
        found = A.set_join(rows, least, apart=("side",))
        want = {(i, j): len({*x} & {*y}) / len({*x} | {*y}) for (i, x), (j, y) in itertools.combinations(sets.items(), 2) if i % 3 != j % 3}
        got = [(r["left_id"], r["right_id"], r["similarity"]) for r in found.collect()]
        assert sorted((i, j) for i, j, _ in got) == sorted(p for p, s in want.items() if s >= least) and all(s == pytest.approx(want[i, j]) for i, j, s in got)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") <= 3
    assert found.inputFiles() and all("/sets-" in f for f in found.inputFiles())


def test_document_graph_analyses_texts_once(spark, tmp_path):
    """Edges come from stored terms and claims, not from the documents again."""
    from weftgraph.operators import build as B

    spark.createDataFrame([(1, "The engine is reliable."), (2, "The engine is not reliable.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    found = B.document_graph(spark.read.parquet(str(tmp_path / "documents"))).edges
    assert found.inputFiles() and not any("/documents/" in f for f in found.inputFiles())
    assert {r["relation"] for r in found.select("relation").collect()} >= {"mentions"}
