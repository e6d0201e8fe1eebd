"""Added and removed keys of two tables, each read and shuffled once."""

from __future__ import annotations

from weftgraph.operators import graph as G


def test_each_table_is_shuffled_once(spark):
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    found = G.diff(table("a", "b", "b", "c", None), table("b", "d", "d", None))
    assert sorted(((r["change"], r["id"]) for r in found.collect()), key=str) == sorted([("removed", "a"), ("removed", "c"), ("added", "d"), ("added", None), ("removed", None)], key=str)
    assert G.diff(table(), table()).count() == 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # four before
