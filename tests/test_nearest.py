"""The nearest vectors of many questions: a task's memory has a bound, its result is that of all pairs."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.operators import retrieval as R


def blocks(rng, n, m, dims):
    rows = lambda k: pa.array(np.round(rng.normal(size=(k, dims)), 1).astype(np.float32).tolist(), pa.list_(pa.float32()))
    return pa.table({"query_id": pa.array(range(n), pa.int64()), "v": rows(n)}), pa.table({"key": pa.array(rng.permutation(m), pa.int64()), "v": rows(m)})


def test_memory_does_not_grow_with_the_square_of_a_block():
    q, v = blocks(np.random.default_rng(1), 1_000, 8_192, 8)
    tracemalloc.start()
    R._nearest(0.25, 10)(q, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000  # the products of all pairs take 65 MB a copy


@pytest.mark.parametrize("least", [0.25, 0.9, -0.5])
def test_equals_all_pairs(monkeypatch, least):
    monkeypatch.setattr(R, "PAIRS", 150)
    q, v = blocks(np.random.default_rng(2), 40, 90, 3)
    odd = pa.table({"key": pa.array([90, 91, 92], pa.int64()), "v": pa.array([[0, 0, 0], [1, None, 1], [float("nan"), 1, 1]], pa.list_(pa.float32()))})
    v = pa.concat_tables([v, odd, v.set_column(0, "key", pa.array(range(100, 190), pa.int64()))])  # ties
    found = [tuple(r.values()) for r in R._nearest(least, 4)(q, v).to_pylist()]
    expected = []
    for a in q.to_pylist():
        x, scored = [float(f) for f in a["v"]], []
        for b in v.to_pylist():
            y = [np.nan if f is None else float(f) for f in b["v"]]
            size = np.sqrt(sum(f * f for f in x)) * np.sqrt(sum(f * f for f in y))
            c = sum(f * g for f, g in zip(x, y, strict=True)) / size if size > 0 else (0.0 if size == 0 else np.nan)
            scored += [(-c, b["key"])] if c >= least else []
        expected += [(a["query_id"], k, -c) for c, k in sorted(scored)[:4]]
    assert [f[:2] for f in found] == [e[:2] for e in expected] and np.allclose([f[2] for f in found], [e[2] for e in expected])
