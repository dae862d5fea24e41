"""Runs a query and its SQL on the same tables and compares names, types and rows."""

import math
from pathlib import Path

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(f"{x:.9g}") if isinstance(x, float) else x


def problem(df, con, sql):
    """None, or what differs."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    theirs = {d[0]: kinds.get(str(d[1]), str(d[1])) for d in got.description}
    ours = dict(df.dtypes)
    if ours != theirs:
        return f"types: {sorted(set(ours.items()) ^ set(theirs.items()))}"
    order = sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(_value(r[n]) for n in order) for r in df.collect()), key=key)
    b = sorted((tuple(_value(r[names.index(n)]) for n in order) for r in got.fetchall()), key=key)
    if len(a) != len(b):
        return f"rows: {len(a)} and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if any(not (p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-7 * max(1, abs(p))) for p, q in zip(x, y))]
    return f"{len(bad)} of {len(a)} rows, first {order}: {bad[0]}" if bad else None
