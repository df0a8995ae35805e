"""The recursions for given parameters, to score or continue models whose parameters are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.forecasting.fleet import SMOOTHING_PATH, arma_fold, arma_path, ordered_values, smoothing_fold
from tidemark.forecasting.series import check_horizon


def _continued(series: DataFrame, fold: str, path: str, horizon: int) -> DataFrame:
    check_horizon(horizon)
    state = ordered_values(series).withColumns({"s": F.expr(fold), "h": F.lit(horizon)})
    days = state.select("series_key", "last_ds", "s", F.posexplode(F.expr(path)).alias("_k", "_v"))
    return days.select(
        "series_key", F.date_add("last_ds", F.col("_k") + 1).alias("ds"), F.greatest("_v", F.lit(0.0)).alias("yhat"),
        F.col("s.sse").alias("sse"),
    )


def holt_winters_fixed(series: DataFrame, alpha: float, beta: float, gamma: float, horizon: int = 30) -> DataFrame:
    """Additive smoothing with given parameters: ``(series_key, ds, yhat, sse)``."""
    return _continued(series, smoothing_fold(f"{alpha}D", f"{beta}D", f"{gamma}D"), SMOOTHING_PATH, horizon)


def arima_fixed(series: DataFrame, phi: float, theta: float, horizon: int = 30) -> DataFrame:
    """ARIMA(1,1,1) with given coefficients: ``(series_key, ds, yhat, sse)``."""
    return _continued(series, arma_fold(f"{phi}D", f"{theta}D"), arma_path(f"{phi}D", f"{theta}D"), horizon)
