"""Runs oracle SQL over the Parquet tables and compares rows whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def expected(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        for table in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}{'/*.parquet' if table.is_dir() else ''}'")
        run = con.execute(sql)
        names = [c[0] for c in run.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in run.fetchall()), key=str)


def actual(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=str)
