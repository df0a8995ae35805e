"""Tree ensembles of MLlib, trained on all series at once.

One pooled model replaces one model per series: MLlib distributes the rows of every tree level over the
cluster, and the series enters as its level, spread and slope over the training days.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.forecasting.series import (
    FEATURES,
    build_features,
    check_horizon,
    confidence_band,
    future_dates,
    future_features,
)
from tidemark.forecasting.simple import FORECAST, RECENT, last_days
from tidemark.functions.dates import calendar_columns
from tidemark.functions.numeric import as_double
from tidemark.operators.cleaning import binary_flag, drop_incomplete
from tidemark.plans.lookups import lookup_join
from tidemark.plans.stages import reusable
from tidemark.spec import PROMO_YES

SEED = 42
BINS = 64
STATS_MB = 1024
# Training rows are dealt to this many tasks by a hash of their keys, so that bagging draws the same rows on any
# cluster; raise it with the number of rows.
TASKS = 8
# Random parts of the rows with equal bins, which bagging draws as wholes.
BLOCKS = 8
# MLlib's limit: trees grow until a leaf cannot be split.
FULL_DEPTH = 30
# The series enters as what is known of it, which works alike for one series and for millions.
SERIES_FEATURES = ["series_mean", "series_dev", "series_trend"]


def forest(trees: int = 200, depth: int = 8, **kw) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=SEED,
        featureSubsetStrategy="all", maxBins=BINS, maxMemoryInMB=STATS_MB, **kw
    )


def boosted(rounds: int = 250, depth: int = 6, rate: float = 0.05) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED,
        subsamplingRate=0.9, featureSubsetStrategy="0.9", maxBins=BINS, maxMemoryInMB=STATS_MB, checkpointInterval=25,
    )


def _assemble(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")


def _describe_series(past: DataFrame) -> DataFrame:
    """Level, spread and slope of every series over its training days, in one grouped aggregate."""
    day = F.unix_date("ds").cast("double")
    return past.groupBy("series_key").agg(
        F.avg("y").alias("series_mean"), F.stddev_pop("y").alias("series_dev"),
        F.coalesce(F.regr_slope("y", day), F.lit(0.0)).alias("series_trend"),
    )


def _spread(ready: DataFrame, keys: list[str], tasks: int = TASKS, kept=("y", "features")) -> DataFrame:
    """Training rows kept for the many passes of MLlib, dealt by a hash of ``keys`` and sorted within tasks."""
    dealt = ready.repartition(tasks, *keys).sortWithinPartitions(*keys).select(*kept)
    return dealt.persist()


def _train_flag(features: DataFrame, train: float) -> DataFrame:
    last = features.groupBy("series_key").agg((F.max("time") + 1).alias("_n"))
    return features.join(last, "series_key").withColumn("train", F.col("time") < F.floor(F.col("_n") * F.lit(train)))


def _fit_and_predict(series: DataFrame, estimator, train: float, leaky: bool, tasks: int = TASKS):
    """Model trained on the first part of every series, with its predictions on the rest."""
    rows = reusable(_train_flag(build_features(series, leaky), train), "features")
    known = reusable(_describe_series(rows.where("train")), "series")
    assemble = _assemble([*FEATURES, *SERIES_FEATURES])
    ready = assemble.transform(rows.join(known, "series_key")).select("series_key", "ds", "y", "train", "features")
    past = _spread(ready.where("train"), ["series_key", "ds"], tasks)
    try:
        model = estimator.fit(past)
    finally:
        past.unpersist()
    tests = model.transform(ready.where(~F.col("train")))
    return model, known, assemble, rows, tests


def _tree_forecast(series, horizon, name, estimator, train, leaky, deviation, spread=None, tasks=TASKS):
    check_horizon(horizon)
    model, known, assemble, rows, tests = _fit_and_predict(series, estimator, train, leaky, tasks)
    ahead = model.transform(assemble.transform(future_features(rows, horizon).join(known, "series_key")))
    spread = deviation(series, tests) if spread is None else spread
    out = ahead.withColumns({"yhat": F.greatest("prediction", F.lit(0.0)), "model": F.lit(name)})
    return confidence_band(out.join(spread, "series_key", "left")).select(*FORECAST)


def _test_residuals(series: DataFrame, tests: DataFrame) -> DataFrame:
    return tests.groupBy("series_key").agg(F.stddev_pop(F.col("y") - F.col("prediction")).alias("std"))


def _recent_spread(series: DataFrame, tests: DataFrame) -> DataFrame:
    return last_days(series, RECENT).groupBy("series_key").agg(F.stddev_samp("y").alias("std"))


def forecast_random_forest(
    series: DataFrame, horizon: int = 30, trees: int = 200, depth: int = 8, train: float = 0.8, leaky: bool = True,
    spread: DataFrame | None = None, tasks: int = TASKS,
) -> DataFrame:
    """Random forest on the nine features; band from the residuals on the test part, or ``spread(series_key, std)``."""
    return _tree_forecast(series, horizon, "random_forest", forest(trees, depth), train, leaky, _test_residuals, spread, tasks)


def forecast_boosted_trees(
    series: DataFrame, horizon: int = 30, rounds: int = 250, depth: int = 6, rate: float = 0.05,
    train: float = 0.8, leaky: bool = True, spread: DataFrame | None = None, tasks: int = TASKS,
) -> DataFrame:
    """Gradient boosted trees on the nine features; band from the last 30 days, or ``spread(series_key, std)``."""
    return _tree_forecast(series, horizon, "boosted_trees", boosted(rounds, depth, rate), train, leaky, _recent_spread, spread, tasks)


def backtest_trees(series: DataFrame, models: list[str], train: float = 0.8, leaky: bool = True, **sizes) -> DataFrame:
    """MAE and RMSE of the pooled tree models per series, with the tree counts used for model choice."""
    out = None
    for name in models:
        estimator = forest(sizes.get("trees", 150)) if name == "random_forest" else boosted(sizes.get("rounds", 200))
        *_, tests = _fit_and_predict(series, estimator, train, leaky)
        error = F.col("y") - F.col("prediction")
        scores = tests.groupBy("series_key").agg(
            F.lit(name).alias("model"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")
        )
        out = scores if out is None else out.unionByName(scores)
    return out


def forecast_calendar_forest(series: DataFrame, horizon: int = 30, trees: int = 100, depth: int = FULL_DEPTH) -> DataFrame:
    """Forest on weekday, month and year only; expects daily totals with missing days as zero."""
    check_horizon(horizon)
    names = ["weekday", "month", "year"]

    def with_calendar(df):
        return df.withColumns({k: v for k, v in calendar_columns("ds").items() if k in names})

    series = reusable(series, "series")
    known = reusable(_describe_series(series), "series")
    assemble = _assemble([*names, *SERIES_FEATURES])
    past = _spread(assemble.transform(with_calendar(series).join(known, "series_key")), ["series_key", "ds"])
    try:
        model = forest(trees, depth).fit(past)
    finally:
        past.unpersist()
    ahead = with_calendar(future_dates(series, horizon)).join(known, "series_key")
    out = model.transform(assemble.transform(ahead))
    return out.select("series_key", F.lit("calendar_forest").alias("model"), "ds", F.col("prediction").alias("yhat"))


def _cuts(values: list[float]) -> list[float]:
    """Borders of at most BINS bins from evenly spaced quantiles: between any two values where these are few, else at
    the quantiles themselves."""
    known = sorted(set(values))
    if len(known) <= BINS:
        return [(a + b) / 2 for a, b in zip(known, known[1:])]
    places = {values[round(k * (len(values) - 1) / BINS)] for k in range(1, BINS)}
    return sorted(places - {known[0]})


def _binned(past: DataFrame, drivers: list[str]) -> Bucketizer:
    """Drivers as numbers of their bins, as MLlib divides them itself before it grows a tree."""
    shares = [k / BINS**2 for k in range(BINS**2 + 1)]
    cuts = [_cuts(values or [0.0]) or [0.0] for values in past.approxQuantile(drivers, shares, 1 / BINS**2)]
    return Bucketizer(
        splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=drivers, outputCols=[f"_bin{i}" for i in range(len(drivers))],
    )


def driver_regression(
    df: DataFrame, target: str, price: str, promo: str, stock: str, marketing: str, holiday: str,
    row_key: list[str], trees: int = 100, depth: int = FULL_DEPTH, test: float = 0.2,
):
    """Sales explained by price, promotion, stock, marketing budget and holiday.

    Returns ``(model, importances, scores)``; the model takes the five drivers as numbers. The random split hashes
    ``row_key`` with the seed, so it does not depend on how the table is partitioned.

    A tree tells rows apart by the bins of their drivers only, and a split by the sums of weights and targets on its
    sides. So rows with equal bins train as one row with their mean and number, in up to BLOCKS random parts that the
    bagging draws: what a tree is grown on is bounded by the bins and not by the rows.
    """
    drivers = [price, promo, stock, marketing, holiday]
    rows = drop_incomplete(df.select(target, *drivers, *[c for c in row_key if c not in drivers]))
    rows = binary_flag(binary_flag(rows, promo, PROMO_YES), holiday, "Yes")
    draw = F.pmod(F.xxhash64(F.lit(SEED), *row_key), F.lit(1_000_000)) / 1_000_000
    block = F.pmod(F.xxhash64(F.lit(SEED + 1), *row_key), F.lit(BLOCKS)).cast("int")
    ready = reusable(rows.select(
        as_double(target).alias("y"), *[as_double(c).alias(c) for c in drivers], (draw < test).alias("test"), block.alias("_block"),
    ).dropna("any", subset=drivers), "drivers")
    binned = _binned(ready.where(~F.col("test")), drivers)
    bins = binned.getOutputCols()
    assemble = VectorAssembler(inputCols=bins, outputCol="features")
    placed = binned.transform(ready).drop(*drivers)
    groups = placed.where(~F.col("test")).groupBy(*bins, "_block").agg(F.avg("y").alias("y"), F.count("y").cast("double").alias("weight"))
    learnt = _spread(assemble.transform(groups), [*bins, "_block"], kept=("y", "weight", "features"))
    try:
        grown = forest(trees, depth, weightCol="weight").fit(learnt)
    finally:
        learnt.unpersist()
    model = PipelineModel([binned, assemble, grown])
    spark = df.sparkSession
    importances = spark.createDataFrame(
        [(d, float(v)) for d, v in zip(drivers, grown.featureImportances.toArray())], "driver string, importance double"
    )
    error = F.col("y") - F.col("prediction")
    # Rows with equal bins have one prediction, so it is worked out once for each of these.
    told = grown.transform(assemble.transform(placed.select(*bins).distinct())).select(*bins, "prediction")
    scores = lookup_join(placed.select("y", "test", *bins), told, bins).groupBy("test").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop("y") * F.count(F.lit(1)))).alias("r2"),
    )
    return model, importances, scores
