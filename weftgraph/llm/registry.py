"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import op10_lattice_lm, op11_fill_in_middle, op12_minhash, op13_prefix_trie, op1_decontaminate, op2_toxicity, op3_language_id, op4_byte_bpe, op5_simhash, op6_html_text, op7_license_scan, op8_topk_search, op9_sstable

_MODULES = (op1_decontaminate, op2_toxicity, op3_language_id, op4_byte_bpe, op5_simhash, op6_html_text, op7_license_scan, op8_topk_search, op9_sstable, op10_lattice_lm, op11_fill_in_middle, op12_minhash, op13_prefix_trie)

#: Each module is named as its query.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(m, name) for m in _MODULES for name in [m.__name__.rpartition(".")[2]]}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
