"""Compare a Spark result with DuckDB's, as multisets of rows over named columns."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

SF_ROOT = "/root/testdata"


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.sql(f"create view {name} as select * from '{path}'")
    return db


def kinds(rows: list[tuple]) -> list[set[str]]:
    return [{type(v).__name__ for v in column} - {"NoneType"} for column in zip(*rows)]


def difference(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or ``None``."""
    ours = [tuple(r[c] for c in sorted(spark_df.columns)) for r in spark_df.collect()]
    relation = db.sql(sql)
    names = [d[0] for d in relation.description]
    order = [names.index(c) for c in sorted(names)]
    theirs = [tuple(r[i] for i in order) for r in relation.fetchall()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    a, b = Counter(ours), Counter(theirs)
    if a != b:
        extra, lacking = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"{len(ours)} rows against {len(theirs)}; extra {extra}; lacking {lacking}"
    if ours and kinds(ours) != kinds(theirs):
        return f"types {kinds(ours)} against {kinds(theirs)}"
    return None
