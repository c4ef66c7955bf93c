"""Shared helper: run a registered query and its DuckDB oracle, compare values."""

from __future__ import annotations

import math

import duckdb

from hindcast.sources.tables import DRIVER_TABLES


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def compare(spark, sf_dir: str, name: str) -> tuple[int, int, bool]:
    import __spark_entry__ as E

    df = E.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in (x.asDict() for x in df.collect()))
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols, (sorted(set(ocols) ^ set(cols)))
    orows = sorted(tuple(_norm(dict(zip(ocols, r))[c]) for c in cols) for r in rel.fetchall())
    return len(srows), len(orows), srows == orows
