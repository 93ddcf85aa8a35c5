"""Comparison of a Spark result with DuckDB's, as bags of rows with columns in order of name."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal


def cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def assert_agree(df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = bag(df.collect(), df.columns), bag(cur.fetchall(), names)
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
