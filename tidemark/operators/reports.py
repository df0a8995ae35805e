"""Reports as long tables ``(section_no, section, position, label, detail, value)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.forecasting.scoring import MODEL, forecast_insights, forecast_summary, forecast_table
from tidemark.operators.aggregates import growth_mean, kpi_summary, top_bottom_categories
from tidemark.operators.filters import filter_sales
from tidemark.operators.profiles import monthly_profile
from tidemark.plans.stages import reusable
from tidemark.spec import SalesSpec

REPORT = ["section_no", "section", "position", "label", "detail", "value"]


def _lines(one: DataFrame, number: int, section: str, values: list[str], keys: list[str] = ()) -> DataFrame:
    """One report line per column of a one-row (or one-row-per-key) table."""
    rows = [
        F.struct(
            F.lit(number).alias("section_no"), F.lit(section).alias("section"), F.lit(i).alias("position"),
            F.lit(v).alias("label"), F.lit(None).cast("string").alias("detail"), F.col(v).cast("double").alias("value"),
        )
        for i, v in enumerate(values, 1)
    ]
    return one.select(*keys, F.inline(F.array(*rows)))


def general_report(df: DataFrame, spec: SalesSpec, start=None, end=None, k: int = 5, **kw) -> DataFrame:
    """Summary, best and worst categories, best month, star and weak category of a period."""
    period = reusable(filter_sales(df, spec, start, end).select(*spec.columns), "report")
    summary = _lines(kpi_summary(period, spec), 1, "summary", ["entries", "total", "mean", "median", "std"])
    growth = growth_mean(period, spec, **kw).select("growth")
    parts = [summary, _lines(growth, 1, "summary", ["growth"]).withColumn("position", F.lit(6))]
    month = monthly_profile(period, spec, "sum").agg(F.max_by("month", F.struct(F.col("value"), -F.col("month"))).alias("best_month"))
    parts.append(_lines(month, 3, "insights", ["best_month"]))
    if spec.cat_col:
        ranked = top_bottom_categories(period, spec, k)
        parts.append(
            ranked.select(
                F.lit(2).alias("section_no"), F.concat("side", F.lit("_categories")).alias("section"),
                F.col("rank").alias("position"), F.lit("category").alias("label"),
                F.col(spec.cat_col).cast("string").alias("detail"), F.col("total").alias("value"),
            )
        )
        star = F.col("side") == "top"
        parts.append(
            ranked.where(F.col("rank") == 1).select(
                F.lit(3).alias("section_no"), F.lit("insights").alias("section"),
                F.when(star, 2).otherwise(3).alias("position"),
                F.when(star, "star_category").otherwise("weak_category").alias("label"),
                F.col(spec.cat_col).cast("string").alias("detail"), F.col("total").alias("value"),
            )
        )
    return reduce(DataFrame.unionByName, parts).select(*REPORT)


def forecast_report(forecast: DataFrame, series: DataFrame) -> DataFrame:
    """Statistics of every forecast, its history and one line per coming day."""
    series, forecast = reusable(series, "series"), reusable(forecast, "forecast")
    stats = forecast_summary(forecast, series).join(forecast_insights(forecast), MODEL)
    numbers = _lines(stats, 1, "statistics", ["mean", "max", "min", "total", "trend", "volatility"], MODEL)
    past = series.groupBy("series_key").agg(F.avg("y").alias("hist_mean"), F.count("y").alias("points"))
    history = _lines(
        forecast.select(*MODEL).distinct().join(past, "series_key"), 2, "history", ["hist_mean", "points"], MODEL
    )
    days = forecast_table(forecast)
    day_no = F.row_number().over(Window.partitionBy(*MODEL).orderBy(F.to_date("date", "dd/MM/yyyy")))
    lines = days.select(
        *MODEL, F.lit(3).alias("section_no"), F.lit("forecast").alias("section"), day_no.alias("position"),
        F.lit("day").alias("label"), F.col("date").alias("detail"), F.col("forecast").alias("value"),
    )
    return reduce(DataFrame.unionByName, [numbers, history, lines]).select(*MODEL, *REPORT)
