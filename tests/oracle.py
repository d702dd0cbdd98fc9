"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set enable_progress_bar=false")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, registry, name: str, folder: str = DATA) -> int:
    df = registry.queries[name](spark, folder)
    mine = rows_of(df.columns, df.collect())
    cur = connect(folder).execute(registry.sql[name])
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(mine) == len(theirs), (len(mine), len(theirs), [x for x in mine if x not in theirs][:3], [x for x in theirs if x not in mine][:3])
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not bad, bad[:3]
    return len(mine)
