"""Back-tests over all models and automatic choice per series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.forecasting.fleet import FITS, backtest_fleet, forecast_fleet
from tidemark.forecasting.simple import SIMPLE_MODELS, backtest_simple
from tidemark.forecasting.trees import backtest_trees, forecast_boosted_trees, forecast_random_forest
from tidemark.plans.stages import reusable

TREE_MODELS = {"random_forest": forecast_random_forest, "boosted_trees": forecast_boosted_trees}
DEFAULT_CANDIDATES = ["naive", "linear", "random_forest", "boosted_trees", "sarima", "decomposable"]


def _known(models: list[str]) -> None:
    unknown = [m for m in models if m not in {*SIMPLE_MODELS, *FITS, *TREE_MODELS}]
    if unknown or not models:
        raise ValueError(f"unknown models {unknown}")


def backtest(series: DataFrame, models: list[str] | None = None, train: float = 0.8, **sizes) -> DataFrame:
    """``(series_key, model, mae, rmse)`` on the last 20 % of every series, split by time."""
    models = models or DEFAULT_CANDIDATES
    _known(models)
    parts = []
    if simple := [m for m in models if m in SIMPLE_MODELS]:
        parts.append(backtest_simple(series, simple, train))
    if fleet := [m for m in models if m in FITS]:
        parts.append(backtest_fleet(series, fleet, train))
    if trees := [m for m in models if m in TREE_MODELS]:
        parts.append(backtest_trees(series, trees, train, **sizes))
    return reduce(DataFrame.unionByName, parts)


def forecast(series: DataFrame, model: str, horizon: int = 30, spread: DataFrame | None = None, **sizes) -> DataFrame:
    """Forecast with one model by name, fitted on the full history.

    A tree model's band comes from ``spread(series_key, std)``, since no days are left to test it on.
    """
    _known([model])
    if model in FITS:
        return forecast_fleet(series, model, horizon)
    if model in TREE_MODELS:
        size = {"random_forest": "trees", "boosted_trees": "rounds"}[model]
        given = {size: sizes[size]} if size in sizes else {}
        return TREE_MODELS[model](series, horizon, train=1.0, spread=spread, **given)
    return SIMPLE_MODELS[model](series, horizon)


def choose_model(scores: DataFrame, models: list[str]) -> DataFrame:
    """The model with the least MAE of every series; on a tie, and over undefined scores, the one listed first."""
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    mae = F.coalesce("mae", F.lit(float("inf")))
    return scores.groupBy("series_key").agg(
        F.min_by(F.struct("model", "mae", "rmse"), F.struct(mae, place)).alias("_best")
    ).select("series_key", "_best.*")


def forecast_auto(series: DataFrame, horizon: int = 30, models: list[str] | None = None, **sizes):
    """``(forecast, choice, scores)``: back-test, choose per series, refit the winner on the full history.

    Every series is fitted only by the model that won it.
    """
    models = models or DEFAULT_CANDIDATES
    series = reusable(series, "series")
    scores = reusable(backtest(series, models, **sizes), "scores")
    choice = choose_model(scores, models)
    choice = reusable(choice, "choice")
    won = reusable(series.join(choice.select("series_key", F.col("model").alias("_won")), "series_key"), "won")
    parts = [forecast(won.where(F.col("_won") == m).drop("_won"), m, horizon) for m in models if m not in TREE_MODELS]
    for m in [m for m in models if m in TREE_MODELS]:
        # A pooled model learns from all series; its forecast is kept where it won.
        mine = choice.where(F.col("model") == m).select("series_key")
        spread = choice.select("series_key", F.col("rmse").alias("std"))
        parts.append(forecast(series, m, horizon, spread, **sizes).join(mine, "series_key", "left_semi"))
    return reduce(DataFrame.unionByName, parts), choice, scores
