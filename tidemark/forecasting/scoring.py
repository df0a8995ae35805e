"""Summaries, reliability and reports of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import as_double, change
from tidemark.operators.filters import last_rows
from tidemark.spec import SalesSpec

MODEL = ["series_key", "model"]
# Penalties of the reliability score.
MAX_VOLATILITY = 70.0
SHORT_HISTORY, SHORT_PENALTY = 60, 12.0
PLAIN_MODELS, PLAIN_PENALTY = ["naive", "smart_ma"], 8.0
ERROR_CAP, ERROR_WEIGHT = 2.0, 40.0
TREND_LIMIT, VOLATILITY_LIMIT = 5, 20


def _history(series: DataFrame) -> DataFrame:
    return series.groupBy("series_key").agg(
        F.avg("y").alias("hist_mean"), F.stddev_samp("y").alias("hist_std"), F.count("y").alias("points")
    )


def forecast_summary(forecast: DataFrame, series: DataFrame) -> DataFrame:
    """Mean, max, min and total of every forecast and its distance to the historical mean in percent."""
    out = forecast.groupBy(*MODEL).agg(
        F.avg("yhat").alias("mean"), F.max("yhat").alias("max"), F.min("yhat").alias("min"), F.sum("yhat").alias("total")
    ).join(_history(series).select("series_key", "hist_mean"), "series_key")
    delta = F.coalesce((F.try_divide("mean", "hist_mean") - 1) * 100, F.lit(0.0))
    return out.withColumn("delta_pct", delta)


def reliability_score(scores: DataFrame, series: DataFrame) -> DataFrame:
    """Score from 0 to 100 out of volatility, length, kind of model and back-test error."""
    rows = scores.join(_history(series), "series_key")
    volatility = F.coalesce(F.try_divide("hist_std", "hist_mean") * 100, F.lit(100.0))
    # An absent or failed back-test costs nothing, as without one.
    error = F.when(F.col("mae").isNotNull() & ~F.isnan("mae"), F.try_divide("mae", "hist_mean"))
    score = (
        F.lit(100.0)
        - F.least(F.lit(MAX_VOLATILITY), volatility)
        - F.when(F.col("points") < SHORT_HISTORY, SHORT_PENALTY).otherwise(0.0)
        - F.when(F.col("model").isin(PLAIN_MODELS), PLAIN_PENALTY).otherwise(0.0)
        - F.coalesce(F.least(F.lit(ERROR_CAP), error), F.lit(0.0)) * ERROR_WEIGHT
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 1)))
    return rows.select(*MODEL, volatility.alias("volatility"), "points", "mae", clipped.alias("reliability"))


def forecast_insights(forecast: DataFrame) -> DataFrame:
    """Change from the first to the last day and relative deviation, with verdicts."""
    out = forecast.groupBy(*MODEL).agg(
        F.min_by("yhat", "ds").alias("first"),
        F.max_by("yhat", "ds").alias("last"),
        (F.try_divide(F.stddev_samp("yhat"), F.avg("yhat")) * 100).alias("_volatility"),
    )
    trend = F.coalesce(change(F.col("last"), F.col("first")) * 100, F.lit(0.0))
    out = out.withColumn("trend", trend).withColumn("volatility", F.coalesce("_volatility", F.lit(0.0)))
    direction = F.when(F.col("trend") > TREND_LIMIT, "up").when(F.col("trend") < -TREND_LIMIT, "down").otherwise("stable")
    risk = F.when(F.col("volatility") > VOLATILITY_LIMIT, "high").otherwise("low")
    return out.select(*MODEL, "trend", direction.alias("direction"), "volatility", risk.alias("risk"))


def forecast_table(forecast: DataFrame) -> DataFrame:
    """Forecast as shown to users: day/month/year and two decimals."""
    return forecast.select(*MODEL, F.date_format("ds", "dd/MM/yyyy").alias("date"), F.round("yhat", 2).alias("forecast"))


def express_forecast(df: DataFrame, spec: SalesSpec, n: int = 30, days: int = 30) -> DataFrame:
    """Next month in one row: mean of the last ``n`` rows, grown by their mean change, times ``days``."""
    recent = last_rows(df.select(*spec.order, as_double(spec.target_col).alias("y")), spec, n)
    # n rows at most reach these windows.
    w = Window.partitionBy(F.lit(0)).orderBy(*spec.order)
    filled = F.last("y", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = recent.withColumn("_filled", filled).withColumn("_previous", F.lag("_filled").over(w))
    out = steps.agg(
        F.avg("y").alias("mean"), F.avg(change(F.col("_filled"), F.col("_previous"))).alias("trend")
    )
    return out.withColumn("next_month", F.col("mean") * (1 + F.col("trend")) * days)


def history_and_forecast(forecast: DataFrame, series: DataFrame) -> DataFrame:
    """History and forecasts in one long table; the bounds are NULL on the history."""
    none = F.lit(None)
    past = series.select(
        "series_key", none.cast("string").alias("model"), F.lit("history").alias("kind"), "ds", F.col("y").alias("value"),
        none.cast("double").alias("lo"), none.cast("double").alias("hi"),
    )
    ahead = forecast.select(
        "series_key", "model", F.lit("forecast").alias("kind"), "ds", F.col("yhat").alias("value"), "lo", "hi"
    )
    return past.unionByName(ahead)
