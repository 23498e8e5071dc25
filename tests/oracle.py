"""Runs a query in Spark and its SQL in DuckDB over one data folder and compares the rows."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.10g}")
    return str(v) if hasattr(v, "isoformat") else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def compare(df, con, sql):
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    kinds = lambda rs: {k: {type(r[k]).__name__ for r in rs} - {"NoneType"} for k in range(len(got[0]))}
    assert kinds(got[1]) == kinds(want[1]), (got[0], kinds(got[1]), kinds(want[1]))
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]), [x for x in got[1] if x not in want[1]][:3], [x for x in want[1] if x not in got[1]][:3])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(got[1])
