"""Row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import day_of
from tidemark.functions.numeric import total
from tidemark.plans.ordered import last_of_keys
from tidemark.spec import SalesSpec

# Rows of a group that every task may send to the one that ranks the group.
RANKED = 100


def in_period(df: DataFrame, column: str, start=None, end=None) -> Column:
    """Inclusive date range; the last day counts to its end.

    Written as a half-open range on the raw column, which reaches the scan for dates and timestamps alike.
    """
    kind = df.schema[column].dataType
    bound = (lambda v: F.lit(str(v)).cast("date")) if isinstance(kind, T.DateType) else (
        lambda v: F.lit(str(v)).cast("date").cast(kind)
    )
    after = lambda v: F.date_add(F.lit(str(v)).cast("date"), 1).cast(kind)
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(column) >= bound(start))
    if end is not None:
        keep = keep & (F.col(column) < after(end))
    return keep


def filter_sales(df: DataFrame, spec: SalesSpec, start=None, end=None, cats=(), regions=()) -> DataFrame:
    """Rows of a period, of some categories and of some regions; an empty list does not filter."""
    if start is not None or end is not None:
        df = df.where(in_period(df, spec.date_col, start, end))
    if cats and spec.cat_col:
        df = df.where(F.col(spec.cat_col).isin(list(cats)))
    if regions and spec.region_col:
        df = df.where(F.col(spec.region_col).isin(list(regions)))
    return df


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def first_values(df: DataFrame, spec: SalesSpec, column: str, k: int) -> DataFrame:
    """The first ``k`` distinct values by appearance in date order, numbered from 1."""
    seen = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*spec.order)).alias("_seen"))
    first = seen.orderBy("_seen", column).limit(k)
    # k rows at most reach this window.
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_seen", column))
    return first.withColumn("position", position).drop("_seen")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def date_bounds(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """First and last date, days between them, number of rows."""
    return df.agg(
        F.min(day_of(spec.date_col)).alias("first_date"),
        F.max(day_of(spec.date_col)).alias("last_date"),
        F.count(F.lit(1)).alias("rows"),
    ).withColumn("span_days", F.datediff("last_date", "first_date"))


def top_rows(df: DataFrame, column: str, n: int = 50, tie: list[str] = (), ascending: bool = False) -> DataFrame:
    """The first ``n`` rows by a column, NULL last, ties by ``tie``."""
    main = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return df.orderBy(main, *tie).limit(n)


def last_rows(df: DataFrame, spec: SalesSpec, n: int, by: list[str] = (), **kw) -> DataFrame:
    """The last ``n`` rows in date order, of the table or of every group; missing group values are a group.

    For a small ``n`` Spark keeps ``n`` rows of every group in each task before the shuffle. For more than
    ``RANKED`` rows the table is cut into range buckets, and only buckets that can hold such rows are ranked, each
    by itself, so that no group has to fit one task.
    """
    newest = [F.col(c).desc() for c in spec.order]
    if not by:
        return df.orderBy(*newest).limit(n)
    if n > RANKED:
        return last_of_keys(df, list(by), spec.order, n, **kw)
    ranked = df.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(*newest)))
    return ranked.where(F.col("_back") <= n).drop("_back")


def latest_value(df: DataFrame, spec: SalesSpec, column: str, by: list[str] = ()) -> DataFrame:
    """Value of the last row in date order."""
    return df.groupBy(*by).agg(F.max_by(column, F.struct(*spec.order)).alias(f"last_{column}"))


def series_points(df: DataFrame, spec: SalesSpec, columns: list[str], rollup: str | None = None) -> DataFrame:
    """Points ``(date, category, columns...)`` for line and scatter charts.

    Every row by default; ``rollup`` day, week, month or year adds the values per step, for charts of large tables
    (add amounts that way, not levels such as stock).
    """
    keys = [spec.cat_col] if spec.cat_col else []
    if rollup is None:
        return df.select(spec.date_col, *keys, *columns)
    step = F.date_trunc(rollup, F.col(spec.date_col).cast("timestamp")).cast("date")
    return df.groupBy(step.alias("date"), *keys).agg(*[total(c).alias(c) for c in columns])
