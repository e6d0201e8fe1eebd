"""Relational operators over the graph tables; every one takes and returns DataFrames."""
