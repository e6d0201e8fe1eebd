"""Accented letters beside the words that decide polarity: Spark against DuckDB."""

from __future__ import annotations

import pytest

from tests.oracle import actual, expected
from weftgraph.plans import registry

TEXTS = ["Gateway ñis gateway.", "Gateway ciónot gateway. Relay is relay.", "Gateway ñdoes gateway server.", "Relay Noñ relay.", "", "Plain words gateway."]


@pytest.mark.parametrize("name", ["heuristic_analysis", "conflict_edges", "document_graph"])
def test_accents(spark, tmp_path, name):
    docs = [(k, t, "es", "web", len(t)) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = expected(str(tmp_path), registry.ORACLES[name])
    assert actual(registry.QUERIES[name](spark, str(tmp_path))) == want and len(want[1]) >= 2
