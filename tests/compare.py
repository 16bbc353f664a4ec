"""Comparing a Spark result with DuckDB's on the same parquet."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """A description of the first differences, or None when the rows agree."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    order = sorted(names)
    mine = Counter(tuple(_cell(r[c]) for c in order) for r in spark_df.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if mine == theirs:
        return None
    extra, lacking = list((mine - theirs).items()), list((theirs - mine).items())
    return (
        f"{sum(mine.values())} vs {sum(theirs.values())} rows; "
        f"only in Spark ({len(extra)}): {extra[:3]}; only in DuckDB ({len(lacking)}): {lacking[:3]}"
    )
