"""Recursions against plain loops, recovery of known parameters, properties of every forecast."""

import datetime as dt
from functools import partial
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.forecasting import fixed, fleet, selection, series, trees
from tidemark.forecasting.series import build_features, future_features
from tidemark.spec import SalesSpec


def frame(spark, **series):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "series_key string, ds date, y double")


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(5)
    t = np.arange(140)
    a = 100 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 2, 140)
    b = 50 + np.cumsum(rng.normal(0, 1, 90))
    return frame(spark, a=a, b=b), {"a": a, "b": b}


def smoothing_loop(y, alpha, beta, gamma, h):
    one, two = y[:7].mean(), y[7:14].mean()
    level, trend, season, sse = one, (two - one) / 7, list(y[:7] - one), 0.0
    for t in range(7, len(y)):
        e = y[t] - level - trend - season[t % 7]
        new = level + trend + alpha * e
        trend += beta * (new - level - trend)
        season[t % 7] += gamma * (y[t] - new - season[t % 7])
        level, sse = new, sse + e * e
    return np.array([level + trend * k + season[(len(y) + k - 1) % 7] for k in range(1, h + 1)]), sse


def arima_loop(y, phi, theta, h):
    w = np.diff(y)
    e = []
    for t in range(len(w)):
        e.append(w[t] - (phi * w[t - 1] + theta * e[t - 1] if t else 0.0))
    out, last, step = [], y[-1], phi * w[-1] + theta * e[-1]
    for _ in range(h):
        last += step
        out.append(last)
        step *= phi
    return np.array(out), float(np.sum(np.square(e[1:])))


def collected(df):
    return {k: g.sort_values("ds") for k, g in df.toPandas().groupby("series_key")}


def test_fixed_smoothing_and_vector_recursion_equal_the_loop(two):
    df, data = two
    out = collected(fixed.holt_winters_fixed(df, 0.2, 0.1, 0.3, 10))
    for key, y in data.items():
        expected, sse = smoothing_loop(y, 0.2, 0.1, 0.3, 10)
        assert out[key]["yhat"].to_numpy() == pytest.approx(np.maximum(expected, 0))
        assert out[key]["sse"].iloc[0] == pytest.approx(sse)
        grid = [np.array([[0.5], [v]]) for v in (0.2, 0.1, 0.3)]
        assert fleet.smoothing_errors(7, *fleet.side_by_side([y]), *grid)[1, 0] == pytest.approx(sse)


def test_fixed_arima_and_vector_recursion_equal_the_loop(two):
    df, data = two
    out = collected(fixed.arima_fixed(df, 0.4, -0.6, 10))
    for key, y in data.items():
        expected, sse = arima_loop(y, 0.4, -0.6, 10)
        assert out[key]["yhat"].to_numpy() == pytest.approx(np.maximum(expected, 0))
        assert out[key]["sse"].iloc[0] == pytest.approx(sse)
        sums = fleet.arma_errors(0, *fleet.side_by_side([y]), np.array([[0.1], [0.4]]), np.array([[0.2], [-0.6]]))
        assert sums[1, 0] == pytest.approx(sse)


def test_series_side_by_side_have_the_errors_of_each_alone():
    rng = np.random.default_rng(2)
    ys = [50 + np.cumsum(rng.normal(0, 1, n)) for n in (90, 30, 41)]
    y, n = fleet.side_by_side(ys)
    weights = rng.random((3, 5, 3))
    for errors, k in ((partial(fleet.smoothing_errors, 7), 3), (partial(fleet.arma_errors, 0), 2), (partial(fleet.seasonal_errors, 0), 4)):
        parameters = [*weights, weights[0] - 0.5][:k]
        together = errors(y, n, *parameters)
        for i, one in enumerate(ys):
            alone = errors(*fleet.side_by_side([one]), *[p[:, i : i + 1] for p in parameters])
            assert together[:, i] == pytest.approx(alone[:, 0])


def test_the_descent_goes_below_every_grid_point():
    rng = np.random.default_rng(4)
    t = np.arange(200)
    ys = [100 + 0.3 * t + 10 * np.sin(2 * np.pi * t / 7) + np.cumsum(rng.normal(0, s, 200)) for s in (0.5, 2.0, 6.0)]
    for errors, search in ((partial(fleet.smoothing_errors, 7), fleet.SMOOTHING_SEARCH), (partial(fleet.arma_errors, 0), fleet.ARMA_SEARCH)):
        y, n = fleet.side_by_side(ys)
        found = fleet.fitted(ys, errors, search)
        least = errors(y, n, *found.T[:, None])[0]
        grid = errors(y, n, *np.repeat(np.array(search.grid, float).T[:, :, None], 3, axis=2)).min(0)
        assert (least <= grid * (1 + 1e-12)).all() and (least < grid * (1 - 1e-6)).any()
        # Another small step to any side does not help any more.
        for side in product((-1e-3, 0, 1e-3), repeat=found.shape[1]):
            moved = np.clip(found + np.array(side), search.low, search.high)
            assert (errors(y, n, *moved.T[:, None])[0] >= least * (1 - 1e-3)).all()


def test_smoothing_of_short_series(spark):
    """Seasons of half the length below two weeks, and a plain trend for very short ones."""
    ys = {"n13": np.tile([1.0, 2, 3, 4, 5, 9], 3)[:13], "n4": np.array([1.0, 5, 1, 5]), "n3": np.array([1.0, 2, 3]), "n2": np.array([4.0, 5])}
    ahead = collected(fleet.forecast_fleet(frame(spark, **ys), "holt_winters", 6))
    assert set(ahead) == set(ys)
    assert ahead["n13"]["yhat"].to_numpy() == pytest.approx([2, 3, 4, 5, 9, 1], abs=1e-6)
    assert ahead["n4"]["yhat"].to_numpy() == pytest.approx([1, 5, 1, 5, 1, 5], abs=1e-6)
    assert ahead["n3"]["yhat"].to_numpy() == pytest.approx([4, 5, 6, 7, 8, 9]) and ahead["n2"]["yhat"].to_numpy() == pytest.approx([6, 7, 8, 9, 10, 11])
    scores = selection.backtest(frame(spark, a=50 + np.arange(15.0)), ["holt_winters"]).first()
    assert np.isfinite(scores["mae"])


def test_a_long_positional_series_gets_its_forecast(spark):
    rng = np.random.default_rng(6)
    y = 1000 + np.cumsum(rng.normal(0, 1, 100_000))
    grid = fleet.Search([(0.0, 0.0), (0.5, 0.5)])
    out = fleet.forecast_fleet(frame(spark, a=y), "arima", 3, grid).orderBy("ds").toPandas()
    assert out["yhat"].to_numpy() == pytest.approx([y[-1]] * 3)


def ahead_of(spark, y, model, days):
    return fleet.forecast_fleet(frame(spark, a=y), model, days).orderBy("ds").toPandas()["yhat"].to_numpy()


def test_arima_recovers_its_parameters(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(0, 1, 4000)
    w = np.zeros(4000)
    for t in range(1, 4000):
        w[t] = 0.6 * w[t - 1] + e[t] - 0.3 * e[t - 1]
    y = 1000 + np.cumsum(w)
    best, _ = arima_loop(y, 0.6, -0.3, 50)
    assert ahead_of(spark, y, "arima", 50) == pytest.approx(best, abs=0.5)


def test_seasonal_difference_is_undone(spark):
    y = np.tile([1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0], 6) + 0.5 * np.arange(42)
    expected = np.tile([1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0], 2) + 0.5 * np.arange(42, 56)
    assert ahead_of(spark, y, "sarima", 14) == pytest.approx(expected, abs=1e-6)


def test_lag_regression_and_decomposable_continue_a_clear_pattern(spark):
    t = np.arange(200)
    y = 10 + 2.0 * t + 5 * np.sin(2 * np.pi * t / 7)
    ahead = np.arange(200, 214)
    expected = 10 + 2.0 * ahead + 5 * np.sin(2 * np.pi * ahead / 7)
    assert ahead_of(spark, y, "decomposable", 14) == pytest.approx(expected, rel=0.02)
    assert ahead_of(spark, 10 + 2.0 * t, "arima_510", 5) == pytest.approx(10 + 2.0 * np.arange(200, 205))


def test_a_bend_is_one_change_point(spark):
    t = np.arange(251)
    noise = np.random.default_rng(3).normal(0, 1, len(t))
    on, between = 80, 100  # places are every eight days
    series = frame(
        spark, a=200 + 1.0 * t + 2.0 * np.maximum(t - on, 0) + noise, b=200 + 3.0 * t - 2.5 * np.maximum(t - between, 0) + noise,
        straight=100 + 2.0 * t + noise, short=np.ones(13),
    )
    found = fleet.change_points(series).toPandas()
    found["day"] = (pd.to_datetime(found["ds"]) - pd.Timestamp(series.agg({"ds": "min"}).first()[0])).dt.days
    strong = found[found["change"].abs() > 0.1]
    a, b = strong[strong["series_key"] == "a"], strong[strong["series_key"] == "b"]
    assert a["day"].tolist() == [on] and a["change"].iloc[0] == pytest.approx(2.0, abs=0.1)
    # No place is nearer than four days, where two places alone would be off by five times the noise.
    assert set(b["day"]) <= {88, 96, 104, 112} and b["change"].sum() == pytest.approx(-2.5, abs=0.15)
    assert set(strong["series_key"]) == {"a", "b"}
    assert (found.groupby("series_key").size() <= 6).all()


def test_lag_regression_equals_least_squares(spark):
    rng = np.random.default_rng(7)
    y = 200 + np.cumsum(rng.normal(0, 3, 120))
    w = np.diff(y)
    lags = np.column_stack([w[5 - k : len(w) - k] for k in range(1, 6)])
    phi, *_ = np.linalg.lstsq(lags, w[5:], rcond=None)
    steps = list(w)
    for _ in range(6):
        steps.append(sum(c * steps[-k] for k, c in enumerate(phi, 1)))
    assert ahead_of(spark, y, "arima_510", 6) == pytest.approx(y[-1] + np.cumsum(steps[-6:]))


def test_series_that_are_too_long_are_listed_and_others_go_on(spark, monkeypatch):
    monkeypatch.setattr(fleet, "MAX_POINTS", 30)
    df = frame(spark, a=np.arange(40.0), b=np.arange(20.0))
    assert [r["series_key"] for r in fleet.too_long(df).collect()] == ["a"]
    assert {r["series_key"] for r in fleet.forecast_fleet(df, "arima", 3).collect()} == {"b"}


@pytest.mark.parametrize("model", [*selection.SIMPLE_MODELS, *fleet.FITS])
def test_properties(two, model):
    df, data = two
    out = collected(selection.forecast(df, model, 21))
    assert set(out) == {"a", "b"}
    for key, g in out.items():
        last = dt.date(2024, 1, 1) + dt.timedelta(days=len(data[key]) - 1)
        assert g["ds"].tolist() == [last + dt.timedelta(days=k) for k in range(1, 22)]
        assert ((g["lo"] <= g["yhat"]) & (g["yhat"] <= g["hi"]) & (g["yhat"] >= 0) & (g["lo"] >= 0)).all()
        assert (g["model"] == model).all()


def test_test_part_does_not_leak_into_training(spark, two):
    df, data = two
    models = ["naive", "linear", "smart_ma", "holt_winters", "arima", "sarima", "decomposable"]
    y = data["a"].copy()
    split = int(len(y) * 0.8)
    train_only = selection.forecast(frame(spark, a=y[:split]), "holt_winters", len(y) - split).toPandas().sort_values("ds")
    scores = {r["model"]: r for r in selection.backtest(df.where("series_key = 'a'"), models).collect()}
    error = y[split:] - train_only["yhat"].to_numpy()
    assert scores["holt_winters"]["mae"] == pytest.approx(np.abs(error).mean())
    assert set(scores) == set(models)
    assert all(s["mae"] <= s["rmse"] + 1e-9 for s in scores.values())


def test_auto_takes_the_least_error_and_refits(two):
    df, _ = two
    models = ["naive", "linear", "smart_ma", "holt_winters"]
    ahead, choice, scores = selection.forecast_auto(df, 7, models)
    table = scores.toPandas()
    won = {r["series_key"]: r["model"] for r in choice.collect()}
    for key, g in table.groupby("series_key"):
        assert won[key] == g.sort_values("mae")["model"].iloc[0]
        part = ahead.where(F.col("series_key") == key).toPandas().sort_values("ds")
        full = selection.forecast(df.where(F.col("series_key") == key), won[key], 7).toPandas().sort_values("ds")
        assert part["yhat"].tolist() == pytest.approx(full["yhat"].tolist())


def test_tie_takes_the_first_model(spark):
    scores = spark.createDataFrame([("a", "linear", 1.0, 1.0), ("a", "naive", 1.0, 1.0)],
                                   "series_key string, model string, mae double, rmse double")
    assert selection.choose_model(scores, ["naive", "linear"]).first()["model"] == "naive"


def test_a_model_without_a_fit_scores_infinity(spark):
    df = frame(spark, a=np.arange(10.0))
    assert selection.backtest(df, ["sarima"]).first()["mae"] == float("inf")


def test_tree_winner_learns_from_the_full_history(spark, monkeypatch):
    seen = []
    spread = trees._spread
    monkeypatch.setattr(trees, "_spread", lambda ready, *a: seen.append(ready.count()) or spread(ready, *a))
    df = frame(spark, a=np.arange(60.0) % 7)
    ahead, choice, _ = selection.forecast_auto(df, 5, ["random_forest"], trees=3)
    assert seen == [48, 60] and choice.first()["model"] == "random_forest"
    assert all(r["lo"] <= r["yhat"] <= r["hi"] for r in ahead.collect())


def test_features_with_and_without_leak(spark):
    df = frame(spark, a=[1, 2, 3, 4])
    leaky = build_features(df).orderBy("ds").toPandas()
    honest = build_features(df, leaky=False).orderBy("ds").toPandas()
    assert leaky["ma_7"].tolist() == [1, 1.5, 2, 2.5] and leaky["lag_1"].tolist() == [1, 1, 2, 3]
    assert honest["ma_7"].tolist() == pytest.approx([1, 1, 4 / 3, 7 / 4])
    ahead = future_features(build_features(df), 2).orderBy("ds").toPandas()
    assert ahead["time"].tolist() == [4, 5] and ahead["lag_1"].tolist() == [4, 4] and ahead["ma_30"].tolist() == [2.5, 2.5]


def test_tree_models(two):
    df, data = two
    for out in (trees.forecast_random_forest(df, 5, trees=5, depth=4), trees.forecast_boosted_trees(df, 5, rounds=3, depth=3)):
        got = collected(out)
        for key, g in got.items():
            assert len(g) == 5 and (g["lo"] <= g["yhat"]).all()
            # Trees cannot leave the range they were trained on.
            low, high = min(v.min() for v in data.values()), max(v.max() for v in data.values())
            assert g["yhat"].between(low - 5, high + 5).all()
    assert trees.forecast_calendar_forest(df, 5, trees=3, depth=4).count() == 10
    scores = trees.backtest_trees(df, ["random_forest", "boosted_trees"], trees=5, rounds=3)
    assert scores.count() == 4 and scores.where("mae <= rmse").count() == 4


def test_driver_regression_split_ignores_partitioning(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": range(400), "price": rng.uniform(1, 9, 400), "stock": rng.uniform(0, 1, 400), "ads": rng.uniform(0, 1, 400)})
    pdf["promo"] = np.where(rng.random(400) < 0.5, "Oui", "Non")
    pdf["holiday"] = "No"
    pdf["y"] = 10 * pdf["price"]
    df = spark.createDataFrame(pdf)
    sizes = set()
    for parts in (1, 5):
        _, importances, scores = trees.driver_regression(df.repartition(parts), "y", "price", "promo", "stock", "ads", "holiday", ["k"], trees=5)
        assert importances.orderBy(F.desc("importance")).first()["driver"] == "price"
        sizes.add(scores.where("test").first()["n"])
    assert len(sizes) == 1


def test_registered_boosting_trains_all_rounds(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry_points

    class Stop(Exception):
        pass

    def caught(series, horizon, name, estimator, *rest):
        raise Stop(name, estimator.getMaxIter())

    monkeypatch.setattr(trees, "_tree_forecast", caught)
    with pytest.raises(Stop) as stop:
        entry_points.queries()["forecast_boosted_trees"](spark, sf_dir)
    assert stop.value.args == ("boosted_trees", 250)


def test_seasonal_search_is_refined_up_to_its_reach():
    rng = np.random.default_rng(4)
    e = rng.normal(0, 1, 3000)
    w = np.zeros(3000)
    for t in range(8, 3000):
        w[t] = e[t] + 0.9 * w[t - 1] - 0.95 * e[t - 7]
    w = w[100:]

    def errors(phi, theta, sphi, stheta):
        ar = [(1, phi), (7, sphi), (8, -phi * sphi)]
        return fleet.squared_innovations(w[:, None], len(w), ar, [(1, theta), (7, stheta), (8, theta * stheta)])

    phi, theta, sphi, stheta = fleet.best_candidates(errors, 1, fleet.SEASONAL_SEARCH)[0]
    assert phi == pytest.approx(0.9, abs=0.11) and stheta == pytest.approx(-0.95, abs=0.11)
    assert theta == pytest.approx(0, abs=0.11) and sphi == pytest.approx(0, abs=0.11)


def test_short_series_get_sarima_without_a_season(spark):
    rng = np.random.default_rng(3)
    ys = {f"n{n}": 50 + np.cumsum(rng.normal(0, 1, n)) for n in (14, 15, 16, 19)}
    df = frame(spark, **ys)
    ahead, plain = (collected(fleet.forecast_fleet(df, model, 4)) for model in ("sarima", "arima"))
    assert set(ahead) == set(ys)
    for key in ("n14", "n15"):
        assert ahead[key]["yhat"].to_numpy() == pytest.approx(plain[key]["yhat"].to_numpy())
    scores = {r["series_key"]: r["mae"] for r in selection.backtest(df, ["sarima"]).collect()}
    assert all(np.isfinite(scores[key]) for key in ys)


@pytest.mark.parametrize("row, function, models", [
    ("forecast_auto_fleet", "forecast_auto", {*selection.DEFAULT_CANDIDATES, "smart_ma", "holt_winters"}),
    ("backtest_trees", "backtest", {"random_forest", "boosted_trees"}),
])
def test_registered_choice_is_over_all_models(spark, sf_dir, monkeypatch, row, function, models):
    import __spark_entry__ as entry_points

    class Stop(Exception):
        pass

    def caught(*given):
        raise Stop(given[-1])

    monkeypatch.setattr(selection, function, caught)
    with pytest.raises(Stop) as stop:
        entry_points.queries()[row](spark, sf_dir)
    assert set(stop.value.args[0]) == models


def test_driver_regression_trains_on_a_bounded_number_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"k": range(n), "price": rng.choice([1.0, 2.0, 5.0], n), "stock": rng.choice([10.0, 20.0], n), "ads": 1.0})
    pdf["promo"], pdf["holiday"] = np.where(rng.random(n) < 0.5, "Oui", "Non"), "No"
    pdf["y"] = 10 * pdf["price"] + pdf["stock"] + rng.normal(0, 1, n)
    sizes, spread = [], trees._spread

    def counted(ready, *args, **kw):
        sizes.append(ready.count())
        return spread(ready, *args, **kw)

    monkeypatch.setattr(trees, "_spread", counted)
    df = spark.createDataFrame(pdf)
    model, _, scores = trees.driver_regression(df, "y", "price", "promo", "stock", "ads", "holiday", ["k"], trees=20, depth=5)
    assert sizes[0] <= 3 * 2 * 2 * trees.BLOCKS
    told = {r["test"]: r for r in scores.collect()}
    assert told[False]["n"] + told[True]["n"] == n and told[True]["r2"] > 0.95
    new = spark.createDataFrame([(5.0, 1.0, 20.0, 1.0, 0.0), (1.0, 0.0, 10.0, 1.0, 0.0)], "price double, promo double, stock double, ads double, holiday double")
    assert [r["prediction"] for r in model.transform(new).collect()] == pytest.approx([70, 20], abs=1)


def test_bins_part_few_values_and_spread_many():
    assert trees._cuts([1.0] * 50 + [2.0, 4.0]) == [1.5, 3.0]
    assert trees._cuts([3.0] * 9) == []
    many = trees._cuts([float(v) for v in range(4097)])
    assert len(many) == trees.BINS - 1 and many[0] == 64


def test_rejected_series_unfolds_no_days(spark):
    rows = [("a|b", "x", "2000-01-01", 1.0), ("a|b", "x", "2000-01-05", 2.0), ("a", "b|x", "2000-01-03", 1.0), ("c", "x", "1990-01-01", 1.0),
            ("c", "x", "2020-01-01", 1.0), ("d", "x", "2000-01-01", None), (None, "x", "2000-01-01", 1.0)]
    df = spark.createDataFrame(rows, "p string, q string, d string, y double").withColumn("d", F.to_date("d"))
    spec = SalesSpec("d", "y", "p")
    found = series.rejected_series(df, spec, ["p", "q"])
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["series_key"], r["n"]) for r in found.collect()) == [("a\\|b|x", 5), ("a|b\\|x", 1)]


@pytest.mark.parametrize("name", ["forecast_holt_winters", "forecast_arima"])
def test_searched_forecasts_give_the_grid_beside_the_search(spark, sf_dir, name):
    import __spark_entry__ as entry_points

    out = {(r["series_key"], r["ds"]): r for r in entry_points.queries()[name](spark, sf_dir).collect()}
    grid = entry_points.queries()[f"{name}_grid"](spark, sf_dir).collect()
    assert len(out) == len(grid)
    for r in grid:
        mine = out[r["series_key"], r["ds"]]
        assert [mine[c] for c in ("yhat", "lo", "hi")] == [r[c] for c in ("yhat", "lo", "hi")] and mine["bounded"] and mine["no_worse"]
