"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def differences(spark_df, con, sql):
    """A list of messages; empty when names, types and rows agree."""
    found = []
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    expected = rows_of(names, result.fetchall())
    actual = rows_of(spark_df.columns, spark_df.collect())
    if actual[0] != expected[0]:
        return [f"columns {actual[0]} != {expected[0]}"]
    for name, kind in spark_df.dtypes:
        if TYPES.get(kind, kind) != kinds[name] and not (kinds[name].startswith(("HUGEINT",)) and kind == "bigint"):
            found.append(f"type of {name}: {kind} / {kinds[name]}")
    if len(actual[1]) != len(expected[1]):
        found.append(f"rows {len(actual[1])} != {len(expected[1])}")
    different = [(a, e) for a, e in zip(actual[1], expected[1]) if a != e]
    if different:
        found.append(f"{len(different)} rows differ, e.g. {different[:2]}")
    return found
