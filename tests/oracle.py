"""Compares registered queries with their SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    at = [want.columns.index(n) for n in names]
    real = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    if got != real:
        a, b = set(got) - set(real), set(real) - set(got)
        return f"{len(got)} and {len(real)} rows; only here {list(a)[:3]}, only in SQL {list(b)[:3]}"
    return None if got else "no rows"
