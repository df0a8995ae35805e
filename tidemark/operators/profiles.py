"""Seasonal profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import day_of
from tidemark.functions.numeric import mean, total
from tidemark.operators.aggregates import with_key
from tidemark.spec import SalesSpec


def _measure(spec: SalesSpec, agg: str):
    return {"mean": mean, "sum": total}[agg](spec.target_col).alias("value")


def monthly_profile(df: DataFrame, spec: SalesSpec, agg: str = "mean") -> DataFrame:
    """Mean or sum per calendar month over all years."""
    d = day_of(spec.date_col)
    return with_key(df, spec.date_col).groupBy(F.month(d).alias("month")).agg(_measure(spec, agg))


def weekday_profile(df: DataFrame, spec: SalesSpec, agg: str = "mean") -> DataFrame:
    """Mean or sum per weekday, Monday = 0."""
    d = day_of(spec.date_col)
    return with_key(df, spec.date_col).groupBy(F.weekday(d).alias("weekday")).agg(_measure(spec, agg))


def season_heatmap(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Mean per day of month (rows) and month (columns m1 .. m12)."""
    d = day_of(spec.date_col)
    cells = with_key(df, spec.date_col).groupBy(F.day(d).alias("day"), F.month(d).alias("month")).agg(
        mean(spec.target_col).alias("value")
    )
    columns = [F.max(F.when(F.col("month") == m, F.col("value"))).alias(f"m{m}") for m in range(1, 13)]
    return cells.groupBy("day").agg(*columns)


def season_extremes(df: DataFrame, spec: SalesSpec, agg: str = "mean") -> DataFrame:
    """Best and worst month and weekday with their values and the gap in percent; ties take the smaller key."""
    d = day_of(spec.date_col)
    y = spec.target_col
    # 84 cells at most, from which both profiles follow.
    cells = with_key(df, spec.date_col).groupBy(F.month(d).alias("month"), F.weekday(d).alias("weekday")).agg(
        F.sum(y).alias("s"), F.count(y).alias("c")
    )
    keys = [F.struct(F.lit(k).alias("period"), F.col(k).alias("key"), F.col("s"), F.col("c")) for k in ("month", "weekday")]
    value = F.sum("s").cast("double")
    if agg == "mean":
        value = F.try_divide(value, F.sum("c").cast("double"))
    p = cells.select(F.inline(F.array(*keys))).groupBy("period", "key").agg(value.alias("value"))
    out = p.where(F.col("value").isNotNull()).groupBy("period").agg(
        F.max_by("key", F.struct(F.col("value"), -F.col("key"))).alias("best"),
        F.max("value").alias("best_value"),
        F.min_by("key", F.struct("value", "key")).alias("worst"),
        F.min("value").alias("worst_value"),
    )
    return out.withColumn("gap", (F.try_divide("best_value", "worst_value") - 1) * 100)
