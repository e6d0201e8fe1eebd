"""All queries of the graph engine and the SQL that checks them."""

from __future__ import annotations

from weftgraph.plans import graph_queries, index_queries, report_queries, retrieval_queries, text_queries

_MODULES = (retrieval_queries, text_queries, graph_queries, report_queries, index_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
