"""Runs a query in Spark and its SQL in DuckDB over the same folder, and compares columns and rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{v:.6f}" if False else str(v)
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


def differences(spark, con, name, run, sql, folder):
    """An empty text if they agree."""
    frame = run(spark, folder)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = [x for x in got[1] if x not in set(want[1])][:2], [x for x in want[1] if x not in set(got[1])][:2]
        return f"{name}: {len(got[1])} and {len(want[1])} rows; only Spark {a}; only DuckDB {b}"
    return "" if got[1] else f"{name}: no rows"
