"""Rows of two engines side by side."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{x:.9g}"
    return str(x)


def rows(columns: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(value(r[i]) for i in order) for r in found)


def duckdb_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    return sorted(columns), rows(columns, out.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, df.collect())
