"""Forecasts in closed form: one grouped aggregate per model, every series in the same job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.forecasting.series import check_horizon, confidence_band, indexed, steps_ahead

FORECAST = ["series_key", "model", "ds", "yhat", "lo", "hi"]
# Weights of the three moving averages, damping of the slope.
MA_WEIGHTS = {7: 0.5, 14: 0.3, 30: 0.2}
SLOPE_DAYS = 14
DAMPING = 0.98
RECENT = 30


def last_days(series: DataFrame, n: int) -> DataFrame:
    """The last ``n`` days of every series, ``back`` = 1 for the last one; cut before the shuffle."""
    newest = Window.partitionBy("series_key").orderBy(F.col("ds").desc())
    return series.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)


def _extend(params: DataFrame, model: str, yhat: Column, horizon: int) -> DataFrame:
    """One row per coming day; ``yhat`` may use ``_step`` (from 0) and the columns of ``params``."""
    check_horizon(horizon)
    days = params.select("*", *steps_ahead(F.col("last_ds"), horizon))
    out = days.withColumn("yhat", F.greatest(yhat, F.lit(0.0))).withColumn("model", F.lit(model))
    return confidence_band(out).select(*FORECAST)


def forecast_naive(series: DataFrame, horizon: int = 30) -> DataFrame:
    """The last value; band from the last 30 days."""
    params = last_days(series, RECENT).groupBy("series_key").agg(
        F.max("ds").alias("last_ds"), F.max_by("y", "ds").alias("last"), F.stddev_pop("y").alias("std")
    )
    return _extend(params, "naive", F.col("last"), horizon)


def forecast_linear(series: DataFrame, horizon: int = 30, clip: bool = True) -> DataFrame:
    """Least-squares line over the days; band from its residuals.

    The residual deviation follows from r2 and the days are counted from a fixed origin, so that one
    aggregate with map-side sums is all it takes.
    """
    x = F.unix_date("ds").cast("double")
    params = series.groupBy("series_key").agg(
        F.max("ds").alias("last_ds"),
        F.regr_slope("y", x).alias("slope"),
        F.regr_intercept("y", x).alias("intercept"),
        F.regr_r2("y", x).alias("r2"),
        F.var_pop("y").alias("var"),
    )
    unexplained = F.greatest(F.lit(0.0), 1 - F.coalesce("r2", F.lit(1.0)))
    params = params.withColumn("std", F.sqrt(F.col("var") * unexplained))
    line = F.col("intercept") + F.col("slope") * F.unix_date("ds")
    if clip:
        return _extend(params, "linear", line, horizon)
    days = params.select("*", *steps_ahead(F.col("last_ds"), horizon)).withColumn("yhat", line)
    return confidence_band(days.withColumn("model", F.lit("linear"))).select(*FORECAST)


def forecast_smart_ma(series: DataFrame, horizon: int = 30) -> DataFrame:
    """Weighted moving averages of 7, 14 and 30 days plus a damped slope of the last 14."""
    recent = last_days(series, max(MA_WEIGHTS))
    means = [F.avg(F.when(F.col("back") <= k, F.col("y"))).alias(f"ma_{k}") for k in MA_WEIGHTS]
    slope = F.when(F.col("back") <= SLOPE_DAYS, F.col("y"))
    params = recent.groupBy("series_key").agg(
        F.max("ds").alias("last_ds"),
        *means,
        F.regr_slope(slope, -F.col("back").cast("double")).alias("slope"),
        F.stddev_samp("y").alias("std"),
    )
    base = sum((F.col(f"ma_{k}") * w for k, w in MA_WEIGHTS.items()), F.lit(0.0))
    damped = F.pow(F.lit(DAMPING), F.col("_step") / 7)
    return _extend(params, "smart_ma", base + F.col("slope") * (F.col("_step") + 1) * damped, horizon)


SIMPLE_MODELS = {"naive": forecast_naive, "linear": forecast_linear, "smart_ma": forecast_smart_ma}


def backtest_simple(series: DataFrame, models: list[str], train: float = 0.8) -> DataFrame:
    """MAE and RMSE of the closed-form models on the last 20 % of every series.

    The smart moving average is scored with the flat mean of the last 7 training days.
    """
    rows = indexed(series, train)
    x = F.col("idx").cast("double")
    past = F.when(F.col("idx") < F.col("split"), F.col("y"))
    week = F.when(F.col("idx").between(F.col("split") - 7, F.col("split") - 1), F.col("y"))
    fits = rows.groupBy("series_key").agg(
        F.max_by("y", F.when(F.col("idx") < F.col("split"), F.col("idx"))).alias("last"),
        F.regr_slope(past, x).alias("slope"),
        F.regr_intercept(past, x).alias("intercept"),
        F.greatest(F.avg(week), F.lit(0.0)).alias("flat"),
    )
    predicted = {
        "naive": F.col("last"),
        "linear": F.col("intercept") + F.col("slope") * x,
        "smart_ma": F.col("flat"),
    }
    # Both sides are partitioned by series already: the join adds no shuffle.
    tests = rows.join(fits, "series_key").where(F.col("idx") >= F.col("split"))
    errors = [e for m in models for e in (
        F.avg(F.abs(F.col("y") - predicted[m])).alias(f"{m}_mae"),
        F.sqrt(F.avg(F.pow(F.col("y") - predicted[m], 2))).alias(f"{m}_rmse"),
    )]
    scores = [F.struct(F.lit(m).alias("model"), F.col(f"{m}_mae").alias("mae"), F.col(f"{m}_rmse").alias("rmse")) for m in models]
    return tests.groupBy("series_key").agg(*errors).select("series_key", F.inline(F.array(*scores)))
