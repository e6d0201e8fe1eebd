"""Every query with an oracle, Spark against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle import actual, expected
from weftgraph.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    assert actual(registry.QUERIES[name](spark, sf_dir)) == expected(sf_dir, registry.ORACLES[name])


def test_entry_has_every_query(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
