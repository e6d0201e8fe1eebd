"""The capped tree against a plain one."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from weftgraph.operators import tree as T


def plain(sources, nodes, most):
    kids, out = defaultdict(dict), []

    def put(parent, row):
        kids[parent][row[0]] = row

    for sid, path, title in sources:
        parts = [p for p in (path or "").split("/") if p]
        label = parts.pop() if parts else title or sid
        at = T.ROOT
        for k, p in enumerate(parts):
            name = T.ROOT + "/" + "/".join(parts[: k + 1])
            put(at, [name, "directory", p, kids[at].get(name, [0, 0, 0, 0])[3] + 1, None])
            at = name
        own = [n for n in nodes if sid in n[3]]
        modules = {n[0] for n in own if n[1] == "module"}
        direct = [n for n in own if n[1] in ("module", "rationale") or (n[1] == "symbol" and n[4] not in modules)]
        put(at, [f"tree:source:{sid}", "source", label, len(direct), None])
        for n in direct:
            inside = [s for s in own if s[1] == "symbol" and s[4] == n[0]] if n[1] == "module" else []
            put(f"tree:source:{sid}", [f"tree:{n[0]}", n[1], n[2], len(inside), n[0]])
            for s in inside:
                put(f"tree:{n[0]}", [f"tree:{s[0]}", "symbol", s[2], 0, s[0]])

    def show(parent):
        rows = sorted(kids[parent].values(), key=lambda r: (T.KINDS.index(r[1]), r[2], r[0]))
        for rank, r in enumerate(rows[:most], 1):
            out.append((r[0], parent, r[1], r[2], r[3], r[4], rank))
            show(r[0])
        if len(rows) > most:
            out.append((f"{parent}:more", parent, "more", f"+{len(rows) - most} more", len(rows) - most, None, most + 1))

    show(T.ROOT)
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 2, 4, 250])
def test_equal_to_a_plain_tree(spark, most):
    draw = random.Random(most)
    sources = [(f"s{i}", draw.choice([None, "", f"f{i}.py", f"src/f{i}.py", f"src/a/f{i}.py", f"src/a/b/f{i}.py", f"/lib//x{i % 3}/f{i}.md"]), draw.choice([None, f"Title {i}"])) for i in range(40)]
    nodes = []
    for i in range(40):
        for m in range(draw.randint(0, 3)):
            nodes.append((f"m{i}-{m}", "module", f"mod {draw.randint(0, 9)}", [f"s{i}"], None))
            nodes += [(f"y{i}-{m}-{k}", "symbol", f"sym {draw.randint(0, 9)}", [f"s{i}"], draw.choice([f"m{i}-{m}", "elsewhere", None])) for k in range(draw.randint(0, 4))]
        nodes += [(f"r{i}-{k}", "rationale", "why", [f"s{i}"], None) for k in range(draw.randint(0, 2))]
    nodes.append(("c", "concept", "no part of it", ["s1"], None))
    frames = spark.createDataFrame(sources, "source_id string, path string, title string"), spark.createDataFrame(nodes, "id string, type string, label string, source_ids array<string>, module_id string")
    got = sorted((tuple(r) for r in T.graph_tree(*frames, most).collect()), key=str)
    assert got == plain(sources, nodes, most)


def test_counts_agree_with_the_whole_tree(spark):
    """What is shown and what the ``more`` rows count make up the whole."""
    sources = spark.createDataFrame([(f"s{i}", f"d/f{i:04d}", None) for i in range(1_500)], "source_id string, path string, title string")
    nodes = spark.createDataFrame([], "id string, type string, label string, source_ids array<string>, module_id string")
    got = T.graph_tree(sources, nodes, 100).collect()
    assert [r["count"] for r in got if r["kind"] == "more"] == [1_400] and [r["label"] for r in sorted(got, key=lambda r: r["rank"]) if r["kind"] == "source"] == [f"f{i:04d}" for i in range(100)]
