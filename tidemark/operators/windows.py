"""Moving averages, lag and fill.

Windows over daily totals partition by series: a series has as many rows as its calendar has days.
Windows over raw rows go through range buckets, whatever the size of a category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import as_double
from tidemark.operators.aggregates import daily_totals, pct_change, with_key
from tidemark.plans.ordered import ROWS_PER_BUCKET, rolling
from tidemark.spec import SalesSpec

__all__ = ["lag_feature", "moving_average", "moving_average_partial", "moving_average_rows", "pct_change"]


def _over_days(by: list[str]):
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("date")


def rolling_mean(value: str, n: int, window, strict: bool = True) -> Column:
    """Mean of the last ``n`` rows; strict means NULL until ``n`` values are there."""
    frame = window.rowsBetween(-(n - 1), 0)
    average = F.avg(value).over(frame)
    return F.when(F.count(value).over(frame) >= n, average) if strict else average


def moving_average(df: DataFrame, spec: SalesSpec, n: tuple[int, ...] = (7, 30), by: list[str] = ()) -> DataFrame:
    """Daily totals with strict moving averages ``ma_<n>``."""
    w = _over_days(list(by))
    return daily_totals(df, spec, list(by)).withColumns({f"ma_{k}": rolling_mean("value", k, w) for k in n})


def moving_average_partial(
    df: DataFrame, spec: SalesSpec, n: tuple[int, ...] = (7, 14, 30), by: list[str] = ()
) -> DataFrame:
    """Daily totals with moving averages that start at the first day."""
    w = _over_days(list(by))
    return daily_totals(df, spec, list(by)).withColumns({f"ma_{k}": rolling_mean("value", k, w, strict=False) for k in n})


def moving_average_rows(
    df: DataFrame,
    spec: SalesSpec,
    n: tuple[int, ...] = (7, 30),
    by: list[str] = (),
    strict: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Moving averages over raw rows in date order, over the whole table or per group."""
    rows = with_key(df, *by).withColumn("_value", as_double(spec.target_col))

    def columns(w):
        return {f"ma_{k}": rolling_mean("_value", k, w, strict) for k in n}

    return rolling(rows, list(by), spec.order, columns, max(n), rows_per_bucket).drop("_value")


def lag_feature(df: DataFrame, spec: SalesSpec, by: list[str] = ()) -> DataFrame:
    """Daily totals with the value of the day before in the data; the first day repeats its own."""
    w = _over_days(list(by))
    return daily_totals(df, spec, list(by)).withColumn("lag_1", F.coalesce(F.lag("value").over(w), F.col("value")))
