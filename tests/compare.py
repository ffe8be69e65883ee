"""Run registered queries and their SQL twins side by side and compare the results."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types and the multiset of rows agree."""
    found = []
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    names = [d[0] for d in result.description]
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    for name, kind in spark_df.dtypes:
        if _KINDS.get(kind) not in (kinds[name], {"STRING": "VARCHAR", "NUMBER": None}.get(kinds[name])):
            found.append(f"type of {name}: {kind} != {kinds[name]}")
    ours = spark_df.collect()
    left, right = _rows(spark_df.columns, ours), _rows(names, theirs)
    if left != right:
        found.append(
            f"rows {len(ours)} vs {len(theirs)}; only spark {list((left - right).items())[:3]}; "
            f"only sql {list((right - left).items())[:3]}"
        )
    elif not ours:
        found.append("no rows at all")
    return found
