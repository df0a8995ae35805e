"""Cleaning and encoding of sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_dates
from tidemark.plans.lookups import lookup_join
from tidemark.plans.ordered import ROWS_PER_BUCKET, row_index
from tidemark.spec import SalesSpec

MAX_DUMMIES = 1000


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """Column as double; rows whose value is not a number are dropped."""
    value = F.trim(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)
    out = df.withColumn(column, value.try_cast("double"))
    return out.where(F.col(column).isNotNull() & ~F.isnan(column))


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=columns)


def prepare(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Parse the date column and drop rows without a date; the order stays a property of ``spec``."""
    if dict(df.dtypes)[spec.date_col] not in ("date", "timestamp", "timestamp_ntz"):
        df = parse_dates(df, spec.date_col)
    return df.where(F.col(spec.date_col).isNotNull())


def binary_flag(df: DataFrame, column: str, truthy: str = "Yes", into: str | None = None) -> DataFrame:
    return df.withColumn(into or column, F.when(F.col(column) == truthy, 1).otherwise(0))


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = True, max_values: int = MAX_DUMMIES) -> DataFrame:
    """One boolean column per category value in sorted order; NULL is false everywhere.

    The values become column names, so more than ``max_values`` of them is an error, not a truncation.
    """
    out = df
    for column in columns:
        rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_values + 1).collect()
        if len(rows) > max_values:
            raise ValueError(f"{column!r} has more than {max_values} values; use one_hot_sparse")
        values = sorted(r[0] for r in rows)[1 if drop_first else 0 :]
        dummies = {f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)) for v in values}
        out = out.withColumns(dummies).drop(column) if dummies else out.drop(column)
    return out


def one_hot_sparse(
    df: DataFrame, columns: list[str], drop_first: bool = True, into: str = "features", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The dummies of any number of values as one sparse vector in place of the columns.

    ``into`` is ``(size, positions)``: the length of the vector, and where it is 1, ascending. Places follow the
    order of ``columns`` and the sorted values of each; with ``drop_first`` a column's smallest value has none. NULL
    has no place. ``<column>_index`` is the place of the value among the column's values from 0, dropped one
    included. Values are numbered over range buckets and looked up by a join, so none of them reach the driver.
    """
    out, size, places, taken = df, F.lit(0).cast("bigint"), [], int(drop_first)
    for column in columns:
        index = f"{column}_index"
        values = row_index(df.select(column).where(F.col(column).isNotNull()).distinct(), [], [column], index, rows_per_bucket=rows_per_bucket)
        out = lookup_join(out, values, [column], "left")
        many = F.coalesce(values.agg(F.max(index)).scalar() + 1 - taken, F.lit(0))
        places.append(F.when(F.col(index) >= taken, size + F.col(index) - taken))
        size = size + many
    vector = F.struct(size.alias("size"), F.array_compact(F.array(*places)).alias("positions"))
    return out.withColumn(into, vector).drop(*columns)


def time_index(
    df: DataFrame, spec: SalesSpec, by: list[str] = (), into: str = "time", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Running number 0 .. n-1 in date order, over the whole table or per group."""
    return row_index(df, list(by), spec.order, into, rows_per_bucket=rows_per_bucket)
