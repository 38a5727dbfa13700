"""Hold queries against their SQL: same columns, same rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    got = rows(spark_df.columns, spark_df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}; first {got[:2]} and {want[:2]}"
    odd = [(g, w) for g, w in zip(got, want) if g != w and not same(g, w)]
    return f"{len(odd)} rows differ, as {odd[0]}" if odd else ""


def same(a: tuple, b: tuple) -> bool:
    return all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.5e-6) for x, y in zip(a, b))
