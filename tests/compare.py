"""Run a named query and its SQL oracle and compare them as unordered rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return columns, cur.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str, show: int = 3) -> list[str]:
    """Empty when the Spark result and the oracle agree."""
    columns, expected = oracle_rows(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    got = _bag(df.columns, df.collect())
    want = _bag(columns, expected)
    if got == want:
        return []
    out = [f"{sum(got.values())} rows, expected {sum(want.values())}"]
    out += [f"only in spark: {r}" for r in list((got - want))[:show]]
    out += [f"only in oracle: {r}" for r in list((want - got))[:show]]
    return out
