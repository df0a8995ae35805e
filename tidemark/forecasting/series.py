"""Daily series ``(series_key, ds, y)`` and their features.

A series is one row per calendar day, so any window or group over ``series_key`` is bounded by the length
of the calendar, not by the number of sales; parallelism comes from the number of series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import calendar_columns, day_of
from tidemark.functions.numeric import as_double
from tidemark.operators.aggregates import daily_totals, with_key
from tidemark.operators.cleaning import coerce_numeric, prepare
from tidemark.operators.windows import rolling_mean
from tidemark.plans.lookups import lookup_join
from tidemark.plans.ordered import ROWS_PER_BUCKET, row_index
from tidemark.plans.stages import reusable
from tidemark.spec import SalesSpec

# Least history, origin of the positional calendar, width of the intervals, features.
MIN_POINTS = 14
POSITIONAL_START = "2024-01-01"
BAND = 1.96
WHOLE = "Globale"
FEATURES = ["time", "day", "month", "weekday", "dayofyear", "quarter", "ma_7", "ma_30", "lag_1"]


def whole_series():
    return Window.partitionBy("series_key")


def by_day():
    return Window.partitionBy("series_key").orderBy("ds")


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return df.withColumn("series_key", F.lit(WHOLE))
    # Separators inside the parts are escaped, so different keys give different series.
    parts = [F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1") for c in by]
    key = F.col(by[0]).cast("string") if len(by) == 1 else F.concat_ws("|", *parts)
    return with_key(df, *by).withColumn("series_key", key)


def _filled_days(df: DataFrame, spec: SalesSpec, by: list[str], fill: str) -> DataFrame:
    daily = daily_totals(df, spec, ["series_key"])
    # A day also stands for the days without sales that follow it: no calendar join is needed.
    follow = F.coalesce(F.date_sub(F.lead("date").over(Window.partitionBy("series_key").orderBy("date")), 1), "date")
    days = daily.withColumn("_until", follow).select(
        "series_key", "value", F.posexplode(F.sequence("date", "_until")).alias("_gap", "ds")
    )
    y = F.col("value") if fill == "ffill" else F.when(F.col("_gap") == 0, F.col("value")).otherwise(0.0)
    return days.select("series_key", "ds", y.alias("y"))


def all_series(
    df: DataFrame,
    spec: SalesSpec,
    by: list[str] = (),
    mode: str = "calendar",
    fill: str = "ffill",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Every series, long enough or not."""
    by = list(by)
    rows = _keyed(_usable(df, spec), by)
    if mode == "positional":
        # Row number instead of date: each row of the series is taken as one day.
        indexed = row_index(rows, ["series_key"], spec.order, "_idx", rows_per_bucket=rows_per_bucket)
        ds = F.date_add(F.lit(POSITIONAL_START).cast("date"), F.col("_idx").cast("int"))
        return indexed.select("series_key", ds.alias("ds"), as_double(spec.target_col).alias("y"))
    _check_calendar(mode, fill)
    return _filled_days(rows, spec, by, fill)


def _usable(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Rows with a date and a value."""
    rows = prepare(coerce_numeric(df, spec.target_col) if _is_text(df, spec.target_col) else df, spec)
    return rows.where(as_double(spec.target_col).isNotNull())


def _check_calendar(mode: str, fill: str) -> None:
    if mode != "calendar" or fill not in ("ffill", "zero"):
        raise ValueError(f"unknown mode {mode!r} or fill {fill!r}")


def _is_text(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] == "string"


def prepare_series(df: DataFrame, spec: SalesSpec, by: list[str] = (), min_points: int = MIN_POINTS, **kw) -> DataFrame:
    """Daily series with at least ``min_points`` points; see ``rejected_series`` for the others."""
    rows = all_series(df, spec, by, **kw)
    if kw.get("mode") == "positional":
        # These series have as many points as the table has rows, so no group is gathered to count them.
        rows = reusable(rows, "positional")
        long = rows.groupBy("series_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
        return lookup_join(rows, long.select("series_key"), ["series_key"], "left_semi")
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(whole_series()))
    return counted.where(F.col("_n") >= min_points).drop("_n")


def rejected_series(
    df: DataFrame, spec: SalesSpec, by: list[str] = (), min_points: int = MIN_POINTS, mode: str = "calendar", fill: str = "ffill", **kw
) -> DataFrame:
    """``(series_key, n, reason)`` of the series with fewer than ``min_points`` points.

    A calendar has all days from the first to the last, so its length needs no day of it; keys are put together
    once per series.
    """
    by = list(by)
    if mode == "positional":
        sizes = _keyed(_usable(df, spec), by).groupBy("series_key").agg(F.count(F.lit(1)).alias("n"))
    else:
        _check_calendar(mode, fill)
        parts = [F.col(c).cast("string").alias(f"_by{i}") for i, c in enumerate(by)]
        days = with_key(_usable(df, spec), *by).select(*parts, day_of(spec.date_col).alias("_day"))
        names = [f"_by{i}" for i in range(len(by))]
        spans = days.groupBy(*names).agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
        n = (F.datediff("_last", "_first") + 1).cast("bigint")
        sizes = _keyed(spans, names).select("series_key", n.alias("n"))
    return sizes.where(F.col("n") < min_points).withColumn("reason", F.lit(f"fewer than {min_points} points"))


def future_dates(series: DataFrame, horizon: int = 30) -> DataFrame:
    """``(series_key, step, ds)`` for the days after the last one, step from 1."""
    check_horizon(horizon)
    last = series.groupBy("series_key").agg(F.max("ds").alias("_last"))
    return last.select("series_key", *steps_ahead(F.col("_last"), horizon))


def check_horizon(horizon: int) -> None:
    if not 1 <= horizon <= 365:
        raise ValueError("the horizon is 1 to 365 days")


def steps_ahead(last: Column, horizon: int) -> list[Column]:
    days = F.sequence(F.date_add(last, 1), F.date_add(last, horizon))
    return [F.posexplode(days).alias("_step", "ds")]


def confidence_band(df: DataFrame, std: str = "std") -> DataFrame:
    """Add ``lo`` (not below 0) and ``hi`` at 1.96 deviations around ``yhat``."""
    reach = BAND * F.coalesce(F.col(std), F.lit(0.0))
    return df.withColumns({"lo": F.greatest(F.col("yhat") - reach, F.lit(0.0)), "hi": F.col("yhat") + reach})


def indexed(series: DataFrame, train: float = 0.8) -> DataFrame:
    """Add the position ``idx``, the length ``n`` and the start ``split`` of the test part."""
    n = F.count(F.lit(1)).over(whole_series())
    out = series.withColumns({"idx": F.row_number().over(by_day()).cast("bigint") - 1, "n": n})
    return out.withColumn("split", F.floor(F.col("n") * F.lit(train)).cast("bigint"))


def build_features(series: DataFrame, leaky: bool = True) -> DataFrame:
    """Nine features per day: position, calendar, moving averages, previous value.

    ``leaky`` moving averages contain the value to be predicted; ``leaky=False`` ends them a day earlier.
    """
    calendar = {k: v for k, v in calendar_columns("ds").items() if k in FEATURES}
    out = series.withColumns({"time": F.row_number().over(by_day()).cast("bigint") - 1, **calendar})
    out = out.withColumn("lag_1", F.coalesce(F.lag("y").over(by_day()), F.col("y")))
    source = "y" if leaky else "lag_1"
    averages = {f"ma_{k}": rolling_mean(source, k, by_day(), strict=False) for k in (7, 30)}
    return out.withColumns(averages).select("series_key", "ds", "y", *FEATURES)


def future_features(features: DataFrame, horizon: int = 30) -> DataFrame:
    """Features of the coming days: calendar and position go on, averages and lag repeat the last ones."""
    check_horizon(horizon)
    last = features.groupBy("series_key").agg(
        F.max_by(F.struct("ds", "y", "time", "ma_7", "ma_30"), "ds").alias("_l")
    )
    days = last.select("series_key", "_l", *steps_ahead(F.col("_l.ds"), horizon))
    calendar = {k: v for k, v in calendar_columns("ds").items() if k in FEATURES}
    out = days.withColumns(calendar).withColumns(
        {
            "time": F.col("_l.time") + F.col("_step") + 1,
            "ma_7": F.col("_l.ma_7"),
            "ma_30": F.col("_l.ma_30"),
            "lag_1": F.col("_l.y"),
        }
    )
    return out.select("series_key", "ds", *FEATURES)
