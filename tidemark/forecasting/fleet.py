"""Recursive models of every series in one job, as Spark SQL folds over each series' ordered values.

A small vectorised helper gives the squared error of many candidate parameters for many series at once. It starts
from a grid and descends from the best candidate in ever smaller steps; Spark folds the values with the parameters found
into the last state and continues from there. The least-squares models add up their normal equations in Spark;
only the small linear system of a series is solved in Python.

A model's forecast of a series is an array, the *path*: a forecast turns it into days, a back-test compares it
with the days that were left out.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import partial, reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.forecasting.series import BAND, MIN_POINTS, check_horizon

SEASON = 7
# A calendar of days stays far below this; only a positional series over raw rows exceeds it, and a recursion visits its
# rows one after the other. Such series get no recursive forecast and are listed by ``too_long``; all others go on.
MAX_POINTS = 1_000_000
# Candidates to start from.
WEIGHTS = (0.01, 0.03, 0.08, 0.15, 0.3, 0.45, 0.6, 0.8, 0.95)
SMOOTHING = list(product(WEIGHTS, (0.0, *WEIGHTS[:-1]), WEIGHTS))
ARMA = [(round(0.1 * p, 1), round(0.1 * q, 1)) for p in range(-9, 10) for q in range(-9, 10)]
# The smallest coefficients first: they win where too few points tell candidates apart.
SEASONAL = sorted(product((-0.8, -0.4, 0.0, 0.4, 0.8), repeat=4), key=lambda g: sum(map(abs, g)))
SIDE_BY_SIDE = 40_000  # candidates times series that are worked out together
ROUNDS = 200  # steps of a descent at most
LAGS = 5


def too_long(series: DataFrame) -> DataFrame:
    """``(series_key, n, reason)`` of the series that the recursive models leave out."""
    sizes = series.groupBy("series_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_POINTS)
    return sizes.withColumn("reason", F.lit(f"more than {MAX_POINTS} points"))


def ordered_values(series: DataFrame) -> DataFrame:
    """``(series_key, last_ds, ys)``: values in date order, of series that are not too long."""
    long = too_long(series).select("series_key")
    points = F.array_sort(F.collect_list(F.struct("ds", "y")))
    short = series.select("series_key", "ds", "y").join(long, "series_key", "left_anti")
    return short.groupBy("series_key").agg(points.alias("_points"), F.max("ds").alias("last_ds")).select(
        "series_key", "last_ds", F.col("_points.y").alias("ys")
    )


def _deviation(ys: str) -> Column:
    """Population deviation, in one walk along the values."""
    return F.expr(f"""aggregate({ys}, named_struct('k', 0D, 'mean', 0D, 'm2', 0D), (s, v) -> transform(array(s.mean + (v - s.mean) / (s.k + 1)),
        new -> named_struct('k', s.k + 1, 'mean', new, 'm2', s.m2 + (v - s.mean) * (v - new)))[0], s -> sqrt(s.m2 / nullif(s.k, 0D)))""")


def _values(series: DataFrame, horizon: int, train: float | None) -> DataFrame:
    """``(series_key, last_ds, ys, h, std, actual)``; with ``train`` the values of the first part only."""
    rows = ordered_values(series)
    if train is None:
        return rows.withColumns({"h": F.lit(horizon), "actual": F.array().cast("array<double>"), "std": _deviation("ys")})
    n = F.size("ys")
    split = F.floor(n * F.lit(train)).cast("int")
    parts = rows.withColumns({"h": n - split, "actual": F.slice("ys", split + 1, n - split), "ys": F.slice("ys", 1, split)})
    return parts.where((F.size("ys") > 0) & (F.col("h") > 0)).withColumn("std", _deviation("ys"))


@dataclass(frozen=True)
class Search:
    """Where the candidates of a model start, and how far and fine a descent may go; ``step`` 0 keeps to the grid."""

    grid: list[tuple]
    step: float = 0.0
    until: float = 1e-3
    low: float = -0.99
    high: float = 0.99


def side_by_side(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series as columns, shorter ones filled up with zeros, and their lengths."""
    n = np.array([len(y) for y in series])
    out = np.zeros((n.max(initial=0), len(series)))
    for column, y in enumerate(series):
        out[: len(y), column] = y
    return out, n


def _least(errors, tried: np.ndarray) -> np.ndarray:
    """Which of the candidates (first axis) is best for every series (second axis), the first of equals."""
    return np.argmin(np.nan_to_num(errors(*np.moveaxis(tried, 2, 0)), nan=np.inf), axis=0)


def best_candidates(errors, many: int, search: Search) -> np.ndarray:
    """Parameters with the least squared error for each of ``many`` series: the best of the grid, then steps to all
    sides of it for as long as they help, halved when they do not. Never worse than the grid."""
    grid = np.array(search.grid, float)
    everyone = np.arange(many)
    best = grid[_least(errors, np.broadcast_to(grid[:, None], (len(grid), many, grid.shape[1])))]
    sides = np.array(sorted(product((-1, 0, 1), repeat=grid.shape[1]), key=lambda m: sum(map(abs, m))), float)
    size = np.full(many, search.step)
    for _ in range(ROUNDS):
        if not (size > search.until).any():
            break
        tried = np.clip(best + sides[:, None] * size[:, None], search.low, search.high)
        tried[0] = best
        pick = _least(errors, tried)
        best = tried[pick, everyone]
        size = np.where(pick > 0, size, size / 2)
    return best


def fitted(series: list[np.ndarray], errors, search: Search) -> np.ndarray:
    """Parameters of every series; ``errors(y, n, *parameters)`` takes series side by side."""
    out = np.zeros((len(series), len(search.grid[0])))
    order = np.argsort([len(y) for y in series], kind="stable")
    width = max(1, SIDE_BY_SIDE // len(search.grid))
    for at in range(0, len(order), width):
        some = order[at : at + width]
        y, n = side_by_side([series[i] for i in some])
        out[some] = best_candidates(partial(errors, y, n), len(some), search)
    return out


def _best(rows: DataFrame, names: list[str], search: Search, errors, fold: str, path: str, std: str = "std", by: str = "0") -> DataFrame:
    """``path``, ``std`` and ``sse`` of the candidate ``p`` with the least squared error, from the last state ``s`` that its
    fold leads to. ``errors(y, n, *parameters, group)`` sees series of one value of ``by`` at a time."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def best(series: pd.Series, group: pd.Series) -> pd.DataFrame:
        found = np.zeros((len(series), len(names)))
        for value in group.unique():
            own = np.flatnonzero(group == value)
            found[own] = fitted([np.asarray(series.iloc[i], float) for i in own], partial(errors, int(value)), search)
        return pd.DataFrame(found, columns=names)

    chosen = rows.withColumn("p", F.explode(F.array(best(F.col("ys"), F.expr(by)))))
    # The state gets its name inside a lambda: it is folded once, whatever uses it.
    result = F.expr(f"inline(transform(array({fold}), s -> struct({path} AS path, {std} AS std, s.sse AS sse)))")
    return chosen.select("series_key", "last_ds", "actual", result)


def squared_innovations(w, n, ar: list[tuple], ma: list[tuple]):
    """Sum of squared innovations after the longest lag, for coefficients given as (lag, values); ``w`` has the series as
    columns of ``n`` values each."""
    longest = max(lag for lag, _ in ar + ma)
    total, recent = np.zeros(ar[0][1].shape), deque(maxlen=longest)
    for t in range(len(w)):
        e = w[t] - sum(c * w[t - k] for k, c in ar if t >= k) - sum(c * recent[-k] for k, c in ma if t >= k)
        recent.append(e)
        if t >= longest:
            total += np.where(t < n, e * e, 0.0)
    return total


# ---- exponential smoothing: additive trend, additive season --------------------------------------


def smoothing_fold(alpha: str, beta: str, gamma: str, m: str = str(SEASON)) -> str:
    """State after ``ys`` with seasons of ``m`` days. The season array is rotated: its head belongs to the current day.

    A season of one day is none: its value stays zero.
    """
    one = f"aggregate(slice(ys, 1, {m}), 0D, (a, v) -> a + v) / {m}"
    two = f"aggregate(slice(ys, {m} + 1, {m}), 0D, (a, v) -> a + v) / {m}"
    start = f"""named_struct('level', {one}, 'trend', ({two} - {one}) / {m},
        'season', transform(slice(ys, 1, {m}), v -> v - {one}), 'sse', 0D, 'err', 0D)"""
    # The new level is needed three times in the next state, so a one-element transform names it.
    step = f"""transform(array(v - s.level - s.trend - s.season[0]), e ->
        transform(array(s.level + s.trend + {alpha} * e), l -> named_struct('level', l,
          'trend', s.trend + {beta} * (l - s.level - s.trend),
          'season', concat(slice(s.season, 2, {m} - 1), array(s.season[0] + if({m} = 1, 0D, {gamma}) * (v - l - s.season[0]))),
          'sse', s.sse + e * e, 'err', s.err + e))[0])[0]"""
    return f"aggregate(slice(ys, {m} + 1, size(ys)), {start}, (s, v) -> {step})"


SMOOTHING_PATH = "transform(sequence(0, h - 1), k -> s.level + s.trend * (k + 1) + s.season[k % size(s.season)])"
SMOOTHING_SEARCH = Search(SMOOTHING, step=0.1, low=0.0, high=0.9999)
ARMA_SEARCH = Search(ARMA, step=0.05)
SEASONAL_SEARCH = Search(SEASONAL, step=0.2, until=0.03)


def smoothing_errors(season: int, y, n, alpha, beta, gamma):
    """Squared error of arrays of weights for series side by side; as :func:`smoothing_fold`."""
    one, two = y[:season].mean(0), y[season : 2 * season].mean(0)
    level, trend = np.broadcast_to(one, alpha.shape), np.broadcast_to((two - one) / season, alpha.shape)
    seasons, sse = [np.broadcast_to(v - one, alpha.shape) for v in y[:season]], np.zeros(alpha.shape)
    for t in range(season, len(y)):
        now = seasons[t % season]
        e = y[t] - level - trend - now
        new = level + trend + alpha * e
        trend = trend + beta * (new - level - trend)
        if season > 1:
            seasons[t % season] = now + gamma * (y[t] - new - now)
        level = new
        sse += np.where(t < n, e * e, 0.0)
    return sse


def _holt_winters(values: DataFrame, search: Search = SMOOTHING_SEARCH) -> DataFrame:
    """Seasons of a week; of half the length for series of less than two weeks, and none for less than four days."""
    n = F.size("ys")
    season = F.when(n >= 2 * SEASON, SEASON).when(n >= 4, F.floor(n / 2)).otherwise(1).cast("int")
    rows = values.where(n >= 2).withColumn("season", season).withColumn("m", n - season)
    fold = smoothing_fold("p.alpha", "p.beta", "p.gamma", "season")
    spread = "sqrt(greatest(s.sse / m - s.err / m * (s.err / m), 0D))"
    return _best(rows, ["alpha", "beta", "gamma"], search, smoothing_errors, fold, SMOOTHING_PATH, spread, "season")


# ---- ARIMA by conditional sum of squares ---------------------------------------------------------


def arma_fold(phi: str, theta: str) -> str:
    """Order (1,1,1): the first innovation is the first difference and does not count into the error."""
    start = "named_struct('y', ys[0], 'w', 0D, 'e', 0D, 'n', 0, 'sse', 0D)"
    step = f"""transform(array(v - s.y - {phi} * s.w - {theta} * s.e), e ->
        named_struct('y', v, 'w', v - s.y, 'e', e, 'n', s.n + 1, 'sse', s.sse + if(s.n = 0, 0D, e * e)))[0]"""
    return f"aggregate(slice(ys, 2, size(ys)), {start}, (s, v) -> {step})"


def arma_path(phi: str, theta: str) -> str:
    """Coming differences shrink by phi: their sum is geometric."""
    return f"transform(sequence(1, h), k -> s.y + ({phi} * s.w + {theta} * s.e) * (1 - pow({phi}, k)) / (1 - {phi}))"


def arma_errors(_, y, n, phi, theta):
    return squared_innovations(np.diff(y, axis=0), n - 1, [(1, phi)], [(1, theta)])


def _arima(values: DataFrame, search: Search = ARMA_SEARCH) -> DataFrame:
    rows = values.where(F.size("ys") >= 3)
    return _best(rows, ["phi", "theta"], search, arma_errors, arma_fold("p.phi", "p.theta"), arma_path("p.phi", "p.theta"))


def _arima_510(values: DataFrame) -> DataFrame:
    """Order (5,1,0): least squares on five lags of the differences."""
    steps = F.expr("transform(sequence(1, size(ys) - 1), t -> ys[t] - ys[t - 1])")
    # As a generated column, the differences are computed once and not anew wherever a lambda uses them.
    rows = values.where(F.size("ys") > 2 * LAGS + 1).withColumn("w", F.explode(F.array(steps)))
    sums = [
        f"aggregate(sequence({LAGS}, size(w) - 1), 0D, (a, t) -> a + w[t - {i}] * w[t - {j}])"
        for i, j in [(i, j) for i in range(LAGS + 1) for j in range(i, LAGS + 1)]
    ]

    @F.pandas_udf("array<double>")
    def solve(moments: pd.Series) -> pd.Series:
        out = []
        for m in moments:
            full = np.zeros((LAGS + 1, LAGS + 1))
            full[np.triu_indices(LAGS + 1)] = m
            full += np.triu(full, 1).T
            out.append(np.linalg.lstsq(full[1:, 1:], full[0, 1:], rcond=None)[0])
        return pd.Series(out)

    solved = rows.withColumn("phi", solve(F.array(*[F.expr(x) for x in sums])))
    ahead = " + ".join(f"phi[{k}] * s.last[{LAGS - 1 - k}]" for k in range(LAGS))
    path = f"""aggregate(sequence(1, h), named_struct('y', ys[size(ys) - 1], 'last', slice(w, -{LAGS}, {LAGS}), 'out', cast(array() AS array<double>)),
        (s, k) -> transform(array({ahead}), d -> named_struct('y', s.y + d, 'last', concat(slice(s.last, 2, {LAGS - 1}), array(d)),
          'out', concat(s.out, array(s.y + d))))[0], s -> s.out)"""
    return solved.select("series_key", "last_ds", "actual", "std", F.expr(path).alias("path"))


# Order (1,1,1)(1,1,1,7): the last eight differences and innovations, the newest last.
_AR = "p.phi * s.w[7] + p.sphi * s.w[1] - p.phi * p.sphi * s.w[0]"
_MA = "p.theta * s.e[7] + p.stheta * s.e[1] + p.theta * p.stheta * s.e[0]"


def seasonal_errors(_, y, n, phi, theta, sphi, stheta):
    d = np.diff(y, axis=0)
    ar = [(1, phi), (SEASON, sphi), (SEASON + 1, -phi * sphi)]
    ma = [(1, theta), (SEASON, stheta), (SEASON + 1, theta * stheta)]
    return squared_innovations(d[SEASON:] - d[:-SEASON], n - SEASON - 1, ar, ma)


def _sarima(values: DataFrame, search: Search = SEASONAL_SEARCH) -> DataFrame:
    """Order (1,1,1)(1,1,1,7); without a season where no two seasonal differences are left."""
    short = (F.size("ys") < 2 * SEASON + 2) & (F.size("ys") + F.size("actual") >= MIN_POINTS)
    rows = values.where(F.size("ys") >= 2 * SEASON + 2).withColumn(
        "w", F.expr(f"transform(sequence({SEASON + 1}, size(ys) - 1), t -> ys[t] - ys[t - 1] - ys[t - {SEASON}] + ys[t - {SEASON + 1}])")
    )
    zeros = f"array_repeat(0D, {SEASON + 1})"
    fold = f"""aggregate(w, named_struct('w', {zeros}, 'e', {zeros}, 'n', 0, 'sse', 0D), (s, v) ->
        transform(array(v - ({_AR}) - ({_MA})), e -> named_struct('w', concat(slice(s.w, 2, {SEASON}), array(v)),
          'e', concat(slice(s.e, 2, {SEASON}), array(e)), 'n', s.n + 1, 'sse', s.sse + if(s.n <= {SEASON}, 0D, e * e)))[0])"""

    # Undo both differences: today's step is the forecast plus the step of a week ago.
    path = f"""aggregate(sequence(1, h), named_struct('w', s.w, 'e', s.e, 'y', ys[size(ys) - 1],
          'd', transform(sequence(size(ys) - {SEASON}, size(ys) - 1), t -> ys[t] - ys[t - 1]), 'out', cast(array() AS array<double>)),
        (s, k) -> transform(array({_AR} + {_MA}), v -> named_struct('w', concat(slice(s.w, 2, {SEASON}), array(v)),
          'e', concat(slice(s.e, 2, {SEASON}), array(0D)), 'y', s.y + s.d[0] + v, 'd', concat(slice(s.d, 2, {SEASON - 1}), array(s.d[0] + v)),
          'out', concat(s.out, array(s.y + s.d[0] + v))))[0], s -> s.out)"""
    names = ["phi", "theta", "sphi", "stheta"]
    return _best(rows, names, search, seasonal_errors, fold, path).unionByName(_arima(values.where(short)))


FOLDS = {"holt_winters": _holt_winters, "arima": _arima, "arima_510": _arima_510, "sarima": _sarima}

# ---- decomposable model: piecewise linear trend, weekly and yearly Fourier terms -----------------

CHANGE_POINTS = 25
CHANGE_RANGE = 0.8
WEEKLY_ORDER, YEARLY_ORDER = 3, 10
SEASON_PENALTY = 0.1
CHANGE_SCALE = 0.05  # scale of the Laplace prior of a change of slope; the series and its time are scaled to 1
NO_CHANGE = 1e-3  # smaller changes are none
START, ROUNDS, NOISE = 20.0, 100, 1e-8
# Number of change points that a series of m days can have.
_KNOTS = f"least({CHANGE_POINTS}, greatest(1, cast(floor(m * {CHANGE_RANGE}) AS int) - 1))"


def _design(drivers: list[str]) -> Column:
    """The row of the design matrix of a day; needs ``idx``, ``m`` (training days), ``ds`` and the drivers."""
    t = "idx / greatest(1, m - 1)"
    waves = []
    for period, order, on in ((7.0, WEEKLY_ORDER, "true"), (365.25, YEARLY_ORDER, "m >= 730")):
        for k in range(1, order + 1):
            angle = f"2 * pi() * {k} * unix_date(ds) / {period}D"
            waves += [f"if({on}, sin({angle}), 0D)", f"if({on}, cos({angle}), 0D)"]
    return F.expr(f"""concat(array(1D, {t}),
        transform(sequence(1, {CHANGE_POINTS}), j -> if(j <= {_KNOTS}, greatest({t} - {CHANGE_RANGE} * j / {_KNOTS}, 0D), 0D)),
        array({', '.join(waves + [f'cast(`{c}` AS double)' for c in drivers])}))""")


def sparse_fit(xx: np.ndarray, xy: np.ndarray, yy: float, m: int, changes: slice) -> np.ndarray:
    """Coefficients from the moments of ``m`` days, with few changes of slope.

    Minimises the squared errors over their variance plus the absolute changes over their scale, by least squares whose
    penalties are set anew from the last changes. As one bend then still is spread over neighbouring places, the sum of
    log(change^2 + NO_CHANGE^2) takes the place of the absolute changes from there on. The changes that remain are fitted
    once more without the others.
    """
    penalty = np.full(len(xy), SEASON_PENALTY)
    penalty[:2], penalty[changes] = 1e-9, START
    beta = np.linalg.solve(xx + np.diag(penalty), xy)
    for weight in (lambda d: 1 / (CHANGE_SCALE * (np.abs(d) + 1e-6)), lambda d: 1 / (d * d + NO_CHANGE**2)):
        for _ in range(ROUNDS):
            noise = max((yy - 2 * beta @ xy + beta @ xx @ beta) / m, NOISE)
            penalty[changes] = noise * weight(beta[changes])
            last, beta = beta, np.linalg.solve(xx + np.diag(penalty), xy)
            if np.abs(beta - last).max() < 1e-7:
                break
    kept = np.ones(len(xy), bool)
    kept[changes] = np.abs(beta[changes]) >= NO_CHANGE
    beta = np.zeros(len(xy))
    beta[kept] = np.linalg.solve(xx[np.ix_(kept, kept)] + np.diag(penalty[kept]), xy[kept])
    return beta


def _decomposed(series: DataFrame, train: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The days of every series with ``idx`` and ``m``, and its fit ``f(beta, sse, err)`` with ``first, last_ds, n, m, scale``."""
    drivers = _drivers(series)
    span = series.groupBy("series_key").agg(F.min("ds").alias("first"), F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"))
    m = F.col("n") if train is None else F.floor(F.col("n") * F.lit(train))
    span = span.withColumn("m", m.cast("int")).where("m >= 14")
    rows = series.join(span, "series_key").withColumn("idx", F.datediff("ds", "first"))
    past = rows.where("idx < m")
    scale = past.groupBy("series_key").agg(F.greatest(F.lit(1.0), F.max(F.abs("y"))).alias("scale"))
    x = F.concat(_design(drivers), F.array(F.col("y") / F.col("scale"))).alias("x")
    size = 2 + CHANGE_POINTS + 2 * (WEEKLY_ORDER + YEARLY_ORDER) + len(drivers) + 1
    pairs = F.expr(f"""inline(flatten(transform(sequence(0, {size - 1}), i -> transform(sequence(i, {size - 1}),
        j -> struct(i AS i, j AS j, x[i] * x[j] AS v)))))""")
    sums = past.join(scale, "series_key").select("series_key", x).select("series_key", pairs)
    sums = sums.groupBy("series_key", "i", "j").agg(F.sum("v").alias("v"))
    system = sums.groupBy("series_key").agg(F.array_sort(F.collect_list(F.struct("i", "j", "v"))).alias("system"))

    @F.pandas_udf("struct<beta:array<double>,sse:double,err:double>")
    def solve(systems: pd.Series, days: pd.Series) -> pd.DataFrame:
        out = []
        for cells, m in zip(systems, days):
            full = np.zeros((size, size))
            for c in cells:
                full[c["i"], c["j"]] = full[c["j"], c["i"]] = c["v"]
            xx, xy = full[:-1, :-1], full[:-1, -1]
            beta = sparse_fit(xx, xy, full[-1, -1], m, slice(2, 2 + CHANGE_POINTS))
            out.append((beta, full[-1, -1] - 2 * beta @ xy + beta @ xx @ beta, xy[0] - xx[0] @ beta))
        return pd.DataFrame(out, columns=["beta", "sse", "err"])

    whole = system.join(span, "series_key").join(scale, "series_key")
    return rows, whole.withColumn("f", solve("system", "m")).drop("system")


def _drivers(series: DataFrame) -> list[str]:
    return [c for c in series.columns if c not in ("series_key", "ds", "y")]


def change_points(series: DataFrame) -> DataFrame:
    """``(series_key, ds, change)``: the days at which the trend of the decomposable model bends, and by how much a day.

    There are at most CHANGE_POINTS places, evenly over the first CHANGE_RANGE of the days; most have no change and no
    row. A place between two days is given as the later one. Series below 14 days have no rows.
    """
    _, fits = _decomposed(series)
    places = fits.select(
        "series_key", "first", "m", "scale", F.expr(_KNOTS).alias("_places"),
        F.posexplode(F.slice("f.beta", 3, CHANGE_POINTS)).alias("_j", "_d"),
    )
    # Rounded, so that a place that is a day but for the last digit is that day.
    at = F.ceil(F.round(CHANGE_RANGE * (F.col("_j") + 1) / F.col("_places") * (F.col("m") - 1), 6)).cast("int")
    return places.where("_d != 0").select(
        "series_key", F.date_add("first", at).alias("ds"), (F.col("_d") * F.col("scale") / (F.col("m") - 1)).alias("change")
    )


def _decomposable(series: DataFrame, horizon: int, train: float | None) -> DataFrame:
    """Trend with few change points, seasons and drivers, fitted by grouped sums. Columns beside the key, day and value
    are drivers; for coming days, on a back-test too, they repeat those of the week before."""
    drivers = _drivers(series)
    rows, fits = _decomposed(series, train)
    past = rows.where("idx < m")
    ahead = F.lit(horizon) if train is None else (F.col("n") - F.col("m")).cast("int")
    days = fits.withColumn("_k", F.explode(F.sequence(F.lit(0), ahead - 1))).withColumns({
        "idx": F.col("m") + F.col("_k"), "ds": F.date_add("first", (F.col("m") + F.col("_k")).cast("int")),
    })
    if drivers:
        week = past.where(f"idx >= m - {SEASON}").select("series_key", (F.col("idx") - F.col("m") + SEASON).alias("_o"), *drivers)
        days = days.withColumn("_o", F.col("_k") % SEASON).join(week, ["series_key", "_o"], "left").na.fill(0.0, drivers)
    value = F.expr("aggregate(zip_with(x, f.beta, (a, b) -> a * b), 0D, (a, v) -> a + v) * scale")
    points = days.withColumn("x", _design(drivers)).select("series_key", "_k", value.alias("v"))
    paths = points.groupBy("series_key").agg(F.array_sort(F.collect_list(F.struct("_k", "v"))).alias("_p"))
    spread = F.expr("sqrt(greatest(f.sse / m - f.err / m * (f.err / m), 0D)) * scale")
    out = paths.join(fits, "series_key").select("series_key", "last_ds", F.col("_p.v").alias("path"), spread.alias("std"))
    if train is None:
        return out
    rest = F.array_sort(F.collect_list(F.struct("idx", "y")))
    actual = rows.where("idx >= m").groupBy("series_key").agg(rest.alias("_a"))
    return out.join(actual, "series_key").withColumn("actual", F.col("_a.y"))


FITS = [*FOLDS, "decomposable"]


def paths(series: DataFrame, model: str, horizon: int, train: float | None = None, search: Search | None = None) -> DataFrame:
    """``(series_key, last_ds, std, path)``, with ``train`` the left-out values ``actual``, and for models with a search
    the squared error ``sse``.

    Series that are too short or too long for a model are not in the result.
    """
    if model == "decomposable":
        return _decomposable(series, horizon, train)
    return FOLDS[model](_values(series, horizon, train), *([search] if search else []))


def forecast_fleet(series: DataFrame, model: str, horizon: int = 30, search: Search | None = None) -> DataFrame:
    """Fit ``model`` to every series and forecast ``horizon`` days; ``search`` replaces the model's own search."""
    check_horizon(horizon)
    found = paths(series, model, horizon, search=search)
    days = found.select("series_key", "last_ds", "std", F.posexplode("path").alias("_k", "_v"))
    yhat, reach = F.greatest("_v", F.lit(0.0)), BAND * F.col("std")
    return days.select(
        "series_key", F.lit(model).alias("model"), F.date_add("last_ds", F.col("_k") + 1).alias("ds"), yhat.alias("yhat"),
        F.greatest(yhat - reach, F.lit(0.0)).alias("lo"), (yhat + reach).alias("hi"),
    )


def backtest_fleet(series: DataFrame, models: list[str], train: float = 0.8) -> DataFrame:
    """MAE and RMSE on the last 20 %; a model without a fit for a series scores infinity there."""
    errors = F.expr("zip_with(path, actual, (a, b) -> b - a)")
    parts = []
    for model in models:
        e = paths(series, model, 0, train).withColumn("_e", errors)
        parts.append(e.select(
            "series_key", F.lit(model).alias("model"),
            F.expr("aggregate(_e, 0D, (a, v) -> a + abs(v)) / size(_e)").alias("mae"),
            F.expr("sqrt(aggregate(_e, 0D, (a, v) -> a + v * v) / size(_e))").alias("rmse"),
        ))
    scores = reduce(DataFrame.unionByName, parts)
    everything = series.select("series_key").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    scored = everything.join(scores, ["series_key", "model"], "left")
    bad = float("inf")
    return scored.select("series_key", "model", *[F.coalesce(F.nanvl(c, F.lit(bad)), F.lit(bad)).alias(c) for c in ("mae", "rmse")])
