"""Series preparation, forecasts, scores."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.registry import oracle, query, rounded
from tidemark.forecasting import fixed, fleet, scoring, selection, series, simple, trees
from tidemark.operators.reports import forecast_report
from tidemark.plans.stages import reusable

H = 30
SIMPLE = ["naive", "linear", "smart_ma"]

# Daily series per product and the closed-form models in SQL.
S = """
WITH RECURSIVE t AS (SELECT product AS k, sale_date AS d, CAST(sum(amount) AS DOUBLE) AS v FROM sales GROUP BY 1, 2),
cal AS (SELECT k, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM t GROUP BY 1),
s0 AS (SELECT cal.k AS series_key, cal.d AS ds, last_value(v IGNORE NULLS) OVER (PARTITION BY cal.k ORDER BY cal.d
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM cal LEFT JOIN t ON t.k = cal.k AND t.d = cal.d),
s AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS i,
             row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) AS back,
             count(*) OVER (PARTITION BY series_key) AS n FROM s0),
h AS (SELECT unnest(generate_series(0, 29)) AS step),
naive AS (SELECT series_key, max(ds) AS last_ds, arg_max(y, ds) AS p, stddev_pop(y) AS std FROM s WHERE back <= 30 GROUP BY 1),
line AS (SELECT series_key, max(ds) AS last_ds, max(n) AS n, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM s GROUP BY 1),
resid AS (SELECT series_key, stddev_pop(y - a - b * i) AS std FROM s JOIN line USING (series_key) GROUP BY 1),
ma AS (SELECT series_key, max(ds) AS last_ds, stddev_samp(y) AS std, 0.5 * avg(y) FILTER (back <= 7)
         + 0.3 * avg(y) FILTER (back <= 14) + 0.2 * avg(y) AS base, regr_slope(y, i) FILTER (back <= 14) AS b
       FROM s WHERE back <= 30 GROUP BY 1),
f0 AS (SELECT series_key, 'naive' AS model, last_ds, step, p AS yhat, std FROM naive CROSS JOIN h
  UNION ALL SELECT series_key, 'linear', last_ds, step, a + b * (n + step), std FROM line JOIN resid USING (series_key) CROSS JOIN h
  UNION ALL SELECT series_key, 'smart_ma', last_ds, step, base + b * (step + 1) * pow(0.98, step / 7.0), std FROM ma CROSS JOIN h),
f1 AS (SELECT series_key, model, CAST(last_ds + CAST(step + 1 AS INTEGER) AS DATE) AS ds, greatest(yhat, 0) AS yhat, std FROM f0),
f AS (SELECT series_key, model, ds, yhat, greatest(yhat - 1.96 * std, 0) AS lo, yhat + 1.96 * std AS hi FROM f1),
sp AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS split FROM s),
fit AS (SELECT series_key, arg_max(y, i) FILTER (i < split) AS last, regr_slope(y, i) FILTER (i < split) AS b,
               regr_intercept(y, i) FILTER (i < split) AS a, greatest(avg(y) FILTER (i >= split - 7 AND i < split), 0) AS flat
        FROM sp GROUP BY 1),
err AS (SELECT series_key, model, y - CASE model WHEN 'naive' THEN last WHEN 'linear' THEN a + b * i ELSE flat END AS e
        FROM sp JOIN fit USING (series_key) CROSS JOIN (VALUES ('naive'), ('linear'), ('smart_ma')) m(model) WHERE i >= split),
score AS (SELECT series_key, model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM err GROUP BY 1, 2),
best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY mae,
          CASE model WHEN 'naive' THEN 1 WHEN 'linear' THEN 2 ELSE 3 END) = 1),
hist AS (SELECT series_key, avg(y) AS hist_mean, stddev_samp(y) AS hist_std, count(*) AS points FROM s GROUP BY 1)
"""
BOUNDS = "yhat lo hi"


def _series(spark, d):
    return series.prepare_series(fx.sales(spark, d), fx.SPEC, ["product"])


def _simple_forecasts(daily):
    out = simple.forecast_naive(daily, H)
    return out.unionByName(simple.forecast_linear(daily, H)).unionByName(simple.forecast_smart_ma(daily, H))


@query("prepare_series", oracle("""
    WITH t AS (SELECT concat(region, '|', product) AS k, sale_date AS d, CAST(sum(amount) AS DOUBLE) AS v FROM sales GROUP BY 1, 2),
    c AS (SELECT k, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS ds FROM t GROUP BY 1)
    SELECT c.k AS series_key, ds, coalesce(v, 0) AS y FROM c LEFT JOIN t ON t.k = c.k AND t.d = c.ds
    QUALIFY count(*) OVER (PARTITION BY c.k) >= 14""", "y"))
def prepare(spark, d):
    return rounded(series.prepare_series(fx.sales(spark, d), fx.SPEC, ["region", "product"], fill="zero"))


POSITIONAL = """
    WITH p AS (SELECT product AS series_key, CAST(DATE '2024-01-01' + CAST(row_number() OVER (PARTITION BY product
                 ORDER BY sale_date, order_id, line_no, part_id, supp_id) - 1 AS INTEGER) AS DATE) AS ds, CAST(amount AS DOUBLE) AS y FROM sales)"""


@query("prepare_series_positional", oracle(POSITIONAL + " SELECT * FROM p", "y"))
def positional(spark, d):
    return rounded(series.prepare_series(fx.sales(spark, d), fx.SPEC, ["product"], mode="positional"))


@query("forecast_linear_positional", oracle(POSITIONAL + """,
    line AS (SELECT series_key, max(ds) AS last_ds, regr_slope(y, ds - DATE '1970-01-01') AS b,
                    regr_intercept(y, ds - DATE '1970-01-01') AS a, sqrt(var_pop(y) * (1 - regr_r2(y, ds - DATE '1970-01-01'))) AS std
             FROM p GROUP BY 1),
    f AS (SELECT series_key, 'linear' AS model, CAST(last_ds + CAST(t.g AS INTEGER) AS DATE) AS ds,
                 greatest(a + b * (last_ds - DATE '1970-01-01' + t.g), 0) AS yhat, std FROM line CROSS JOIN generate_series(1, 30) t(g))
    SELECT series_key, model, ds, yhat, greatest(yhat - 1.96 * std, 0) AS lo, yhat + 1.96 * std AS hi FROM f""", "yhat lo hi"))
def linear_positional(spark, d):
    rows = series.prepare_series(fx.sales(spark, d), fx.SPEC, ["product"], mode="positional")
    return rounded(simple.forecast_linear(rows, H))


@query("rejected_series", oracle("""
    WITH t AS (SELECT DISTINCT concat(region, '|', CAST(part_id AS VARCHAR)) AS k, sale_date AS d FROM sales),
    n AS (SELECT k AS series_key, CAST(max(d) - min(d) + 1 AS BIGINT) AS n FROM t GROUP BY 1)
    SELECT *, 'fewer than 14 points' AS reason FROM n WHERE n < 14"""))
def rejected(spark, d):
    return series.rejected_series(fx.sales(spark, d), fx.SPEC, ["region", "part_id"])


@query("prepare_series_keys", oracle("""
    WITH t AS (SELECT CASE WHEN line_no % 2 = 0 THEN concat(region, '\\|x|', 'y') ELSE concat(region, '|', 'x\\|y') END AS k,
                      sale_date AS d, CAST(sum(amount) AS DOUBLE) AS v FROM sales GROUP BY 1, 2),
    c AS (SELECT k, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS ds FROM t GROUP BY 1)
    SELECT c.k AS series_key, ds, coalesce(v, 0) AS y FROM c LEFT JOIN t ON t.k = c.k AND t.d = c.ds""", "y"))
def separators_in_keys(spark, d):
    """Key parts that hold the separator stay apart."""
    even = F.col("line_no") % 2 == 0
    sales = fx.sales(spark, d).withColumns({
        "a": F.when(even, F.concat("region", F.lit("|x"))).otherwise(F.col("region")), "b": F.when(even, F.lit("y")).otherwise(F.lit("x|y"))})
    return rounded(series.prepare_series(sales, fx.SPEC, ["a", "b"], fill="zero"))


@query("prepare_series_nan", oracle("""
    WITH t AS (SELECT product AS k, sale_date AS d, CAST(sum(amount) AS DOUBLE) AS v FROM sales WHERE order_id % 7 <> 0 GROUP BY 1, 2),
    c AS (SELECT k, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS ds FROM t GROUP BY 1)
    SELECT c.k AS series_key, ds, coalesce(v, 0) AS y FROM c LEFT JOIN t ON t.k = c.k AND t.d = c.ds""", "y"))
def prepare_nan(spark, d):
    amount = F.when(F.col("order_id") % 7 == 0, float("nan")).otherwise(F.col("amount").cast("double"))
    return rounded(series.prepare_series(fx.sales(spark, d).withColumn("amount", amount), fx.SPEC, ["product"], fill="zero"))


@query("future_dates", oracle(S + """
    SELECT series_key, CAST(step AS INTEGER) AS _step, CAST(max(ds) + CAST(step + 1 AS INTEGER) AS DATE) AS ds
    FROM s CROSS JOIN h GROUP BY series_key, step"""))
def future(spark, d):
    return series.future_dates(_series(spark, d), H)


@query("confidence_band", oracle(S + "SELECT ds, yhat, std, lo, hi FROM (SELECT *, greatest(yhat - 1.96 * std, 0) AS lo, yhat + 1.96 * std AS hi"
       " FROM (SELECT s.ds, y AS yhat, hist_std AS std FROM s JOIN hist USING (series_key)))", "yhat std lo hi"))
def band(spark, d):
    daily = _series(spark, d)
    spread = daily.groupBy("series_key").agg(F.stddev_samp("y").alias("std"))
    rows = daily.join(spread, "series_key").select("ds", F.col("y").alias("yhat"), "std")
    return rounded(series.confidence_band(rows))


@query("build_features", oracle(S + """
    SELECT series_key, ds, y, i AS time, CAST(day(ds) AS INTEGER) AS day, CAST(month(ds) AS INTEGER) AS month,
      CAST(isodow(ds) - 1 AS INTEGER) AS weekday, CAST(dayofyear(ds) AS INTEGER) AS dayofyear, CAST(quarter(ds) AS INTEGER) AS quarter,
      avg(y) OVER (PARTITION BY series_key ORDER BY ds ROWS 6 PRECEDING) AS ma_7,
      avg(y) OVER (PARTITION BY series_key ORDER BY ds ROWS 29 PRECEDING) AS ma_30,
      coalesce(lag(y) OVER (PARTITION BY series_key ORDER BY ds), y) AS lag_1 FROM s""", "y ma_7 ma_30 lag_1"))
def features(spark, d):
    return rounded(series.build_features(_series(spark, d)))


@query("future_features", oracle(S + """
    SELECT series_key, ds, n + step AS time, CAST(day(ds) AS INTEGER) AS day, CAST(month(ds) AS INTEGER) AS month,
      CAST(isodow(ds) - 1 AS INTEGER) AS weekday, CAST(dayofyear(ds) AS INTEGER) AS dayofyear, CAST(quarter(ds) AS INTEGER) AS quarter,
      ma_7, ma_30, lag_1
    FROM (SELECT series_key, step, max(n) AS n, CAST(max(ds) + CAST(step + 1 AS INTEGER) AS DATE) AS ds,
            avg(y) FILTER (back <= 7) AS ma_7, avg(y) FILTER (back <= 30) AS ma_30, arg_max(y, ds) AS lag_1
          FROM s CROSS JOIN h GROUP BY series_key, step)""", "ma_7 ma_30 lag_1"))
def features_ahead(spark, d):
    return rounded(series.future_features(series.build_features(_series(spark, d)), H))


@query("forecast_naive", oracle(S + "SELECT * FROM f WHERE model = 'naive'", BOUNDS))
def naive(spark, d):
    return rounded(simple.forecast_naive(_series(spark, d), H))


@query("forecast_linear", oracle(S + "SELECT * FROM f WHERE model = 'linear'", BOUNDS))
def linear(spark, d):
    return rounded(simple.forecast_linear(_series(spark, d), H))


@query("forecast_smart_ma", oracle(S + "SELECT * FROM f WHERE model = 'smart_ma'", BOUNDS))
def smart_ma(spark, d):
    return rounded(simple.forecast_smart_ma(_series(spark, d), H))


def _grid(names, values):
    rows = ", ".join("(" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in g) + ")" for g in values)
    return f"g({names}) AS (VALUES {rows})"


# Fixed candidates of the rows whose whole search is repeated in SQL.
FEW_WEIGHTS = fleet.Search(list(product((0.02, 0.1, 0.25, 0.5, 0.8), (0.0, 0.01, 0.05, 0.2), (0.02, 0.1, 0.25, 0.5))))
ARMA_GRID = fleet.Search(fleet.ARMA)


def _coming(model, flags):
    """SQL of a forecast's properties: every series goes on for H days without a gap, and all flags hold."""
    names = ", ".join(f"true AS {f}" for f in flags)
    named = f"'{model}' AS model, " if model else ""
    return oracle(S + f"SELECT series_key, {named}CAST(last_ds + CAST(step + 1 AS INTEGER) AS DATE) AS ds, {names} FROM line CROSS JOIN h")


def _bounded(ahead, *keep):
    """Whether each day's forecast lies within its band and none of them is negative or missing."""
    inside = (F.col("lo") >= 0) & (F.col("lo") <= F.col("yhat")) & (F.col("yhat") <= F.col("hi"))
    return ahead.withColumn("bounded", F.coalesce(inside, F.lit(False))).select("series_key", *keep, "ds", "bounded")


def _searching(sql):
    """SQL of :func:`_searched`: the forecast of the whole grid, and that both flags hold on every day."""
    return oracle(f"SELECT *, true AS bounded, true AS no_worse FROM ({sql})", BOUNDS, 2)


def _searched(daily, model, grid):
    """The forecast of the grid's best candidate, beside the model's own search: whether each day of that one's forecast is
    bounded, and whether its squared error is not above the least of the grid."""
    daily = reusable(daily, "series")
    least = fleet.paths(daily, model, H, search=grid).select("series_key", F.col("sse").alias("least"))
    own = fleet.paths(daily, model, H).select("series_key", "sse").join(least, "series_key")
    flags = own.select("series_key", F.coalesce(F.col("sse") <= F.col("least") * (1 + 1e-9), F.lit(False)).alias("no_worse"))
    sound = _bounded(fleet.forecast_fleet(daily, model, H), "model").join(flags, "series_key")
    return fleet.forecast_fleet(daily, model, H, grid).join(sound, ["series_key", "model", "ds"])


HOLT_WINTERS = S + ", " + _grid("ga, gb, gc", FEW_WEIGHTS.grid) + """,
    st AS (SELECT series_key, avg(y) FILTER (i < 7) AS one, avg(y) FILTER (i >= 7 AND i < 14) AS two FROM s GROUP BY 1),
    run AS (
      SELECT series_key, ga, gb, gc, CAST(7 AS BIGINT) AS i, one AS level, (two - one) / 7 AS trend,
             (SELECT list(y - one ORDER BY i) FROM s WHERE s.series_key = st.series_key AND s.i < 7) AS season,
             CAST(0 AS DOUBLE) AS sse, CAST(0 AS DOUBLE) AS err
      FROM st CROSS JOIN g
      UNION ALL
      SELECT series_key, ga, gb, gc, i, lv AS level, trend + gb * (lv - level - trend), list_append(season[2:], season[1] + gc * (y - lv - season[1])),
             sse + e * e, err + e
      FROM (SELECT r.series_key, ga, gb, gc, r.i + 1 AS i, r.level, r.trend, r.season, r.sse, r.err, s.y,
                   s.y - r.level - r.trend - r.season[1] AS e, r.level + r.trend + ga * (s.y - r.level - r.trend - r.season[1]) AS lv
            FROM run r JOIN s ON s.series_key = r.series_key AND s.i = r.i)),
    fin AS (SELECT run.*, last_ds, line.n - 7 AS m FROM run JOIN line ON line.series_key = run.series_key AND run.i = line.n
            QUALIFY row_number() OVER (PARTITION BY run.series_key ORDER BY sse, ga, gb, gc) = 1),
    o AS (SELECT series_key, 'holt_winters' AS model, CAST(last_ds + CAST(step + 1 AS INTEGER) AS DATE) AS ds,
           greatest(level + trend * (step + 1) + season[(step % 7) + 1], 0) AS yhat, 1.96 * sqrt(sse / m - pow(err / m, 2)) AS reach
          FROM fin CROSS JOIN h)
    SELECT series_key, model, ds, yhat, greatest(yhat - reach, 0) AS lo, yhat + reach AS hi FROM o"""


@query("forecast_holt_winters", _searching(HOLT_WINTERS))
def holt_winters(spark, d):
    """The grid's forecast, which SQL repeats, and whether the continuous search is sound and never worse than it."""
    return rounded(_searched(_series(spark, d), "holt_winters", FEW_WEIGHTS), 2)


@query("forecast_holt_winters_grid", oracle(HOLT_WINTERS, BOUNDS, 2))
def holt_winters_grid(spark, d):
    return rounded(fleet.forecast_fleet(_series(spark, d), "holt_winters", H, FEW_WEIGHTS), 2)


# The season array is rotated: its first entry belongs to the current day.
@query("forecast_holt_winters_fixed", oracle(S + """,
    st AS (SELECT series_key, avg(y) FILTER (i < 7) AS one, avg(y) FILTER (i >= 7 AND i < 14) AS two FROM s GROUP BY 1),
    run AS (
      SELECT series_key, CAST(7 AS BIGINT) AS i, one AS level, (two - one) / 7 AS trend,
             (SELECT list(y - one ORDER BY i) FROM s WHERE s.series_key = st.series_key AND s.i < 7) AS season, CAST(0 AS DOUBLE) AS sse
      FROM st
      UNION ALL
      SELECT series_key, i, lv AS level, trend + 0.1 * (lv - level - trend), list_append(season[2:], season[1] + 0.1 * (y - lv - season[1])),
             sse + e * e
      FROM (SELECT r.series_key, r.i + 1 AS i, r.level, r.trend, r.season, r.sse, s.y, s.y - r.level - r.trend - r.season[1] AS e,
                   r.level + r.trend + 0.2 * (s.y - r.level - r.trend - r.season[1]) AS lv
            FROM run r JOIN s ON s.series_key = r.series_key AND s.i = r.i)),
    fin AS (SELECT run.*, last_ds FROM run JOIN line ON line.series_key = run.series_key AND run.i = line.n)
    SELECT series_key, CAST(last_ds + CAST(step + 1 AS INTEGER) AS DATE) AS ds,
           greatest(level + trend * (step + 1) + season[(step % 7) + 1], 0) AS yhat, sse FROM fin CROSS JOIN h""", "yhat sse", sse=-3))
def holt_winters_fixed(spark, d):
    return rounded(fixed.holt_winters_fixed(_series(spark, d), 0.2, 0.1, 0.1, H), sse=-3)


@query("forecast_random_forest", _coming('random_forest', ["bounded"]))
def random_forest(spark, d):
    return _bounded(trees.forecast_random_forest(_series(spark, d), H), "model")


@query("forecast_boosted_trees", _coming('boosted_trees', ["bounded"]))
def boosted_trees(spark, d):
    return _bounded(trees.forecast_boosted_trees(_series(spark, d), H), "model")


ARIMA = S + ", " + _grid("p, q", ARMA_GRID.grid) + """,
    run AS (
      SELECT series_key, p, q, CAST(1 AS BIGINT) AS i, y, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS sse
      FROM s CROSS JOIN g WHERE s.i = 0
      UNION ALL
      SELECT r.series_key, p, q, r.i + 1, s.y, s.y - r.y, s.y - r.y - p * r.w - q * r.e,
             r.sse + CASE WHEN r.i = 1 THEN 0 ELSE pow(s.y - r.y - p * r.w - q * r.e, 2) END
      FROM run r JOIN s ON s.series_key = r.series_key AND s.i = r.i),
    dev AS (SELECT series_key, stddev_pop(y) AS std FROM s GROUP BY 1),
    fin AS (SELECT run.*, last_ds, std FROM run JOIN line ON line.series_key = run.series_key AND run.i = line.n
              JOIN dev ON dev.series_key = run.series_key
            QUALIFY row_number() OVER (PARTITION BY run.series_key ORDER BY sse, p, q) = 1),
    o AS (SELECT series_key, 'arima' AS model, CAST(last_ds + CAST(step + 1 AS INTEGER) AS DATE) AS ds,
           greatest(y + (p * w + q * e) * (1 - pow(p, step + 1)) / (1 - p), 0) AS yhat, 1.96 * std AS reach FROM fin CROSS JOIN h)
    SELECT series_key, model, ds, yhat, greatest(yhat - reach, 0) AS lo, yhat + reach AS hi FROM o"""


@query("forecast_arima", _searching(ARIMA))
def arima(spark, d):
    """The grid's forecast, which SQL repeats, and whether the continuous search is sound and never worse than it."""
    return rounded(_searched(_series(spark, d), "arima", ARMA_GRID), 2)


@query("forecast_arima_grid", oracle(ARIMA, BOUNDS, 2))
def arima_grid(spark, d):
    return rounded(fleet.forecast_fleet(_series(spark, d), "arima", H, ARMA_GRID), 2)


@query("forecast_arima_510", _coming('arima_510', ["bounded"]))
def arima_510(spark, d):
    return _bounded(fleet.forecast_fleet(_series(spark, d), "arima_510", H), "model")


@query("forecast_arima_fixed", oracle(S + """,
    run AS (
      SELECT series_key, CAST(1 AS BIGINT) AS i, y, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS sse FROM s WHERE s.i = 0
      UNION ALL
      SELECT r.series_key, r.i + 1, s.y, s.y - r.y, s.y - r.y - 0.3 * r.w + 0.8 * r.e,
             r.sse + CASE WHEN r.i = 1 THEN 0 ELSE pow(s.y - r.y - 0.3 * r.w + 0.8 * r.e, 2) END
      FROM run r JOIN s ON s.series_key = r.series_key AND s.i = r.i),
    fin AS (SELECT run.*, last_ds FROM run JOIN line ON line.series_key = run.series_key AND run.i = line.n)
    SELECT series_key, CAST(last_ds + CAST(step + 1 AS INTEGER) AS DATE) AS ds,
           greatest(y + (0.3 * w - 0.8 * e) * (1 - pow(0.3, step + 1)) / 0.7, 0) AS yhat, sse FROM fin CROSS JOIN h""", "yhat sse", sse=-3))
def arima_fixed(spark, d):
    return rounded(fixed.arima_fixed(_series(spark, d), 0.3, -0.8, H), sse=-3)


@query("forecast_sarima", _coming('sarima', ["bounded"]))
def sarima(spark, d):
    return _bounded(fleet.forecast_fleet(_series(spark, d), "sarima", H), "model")


@query("forecast_decomposable", _coming('decomposable', ["bounded"]))
def decomposable(spark, d):
    """With the share of promoted and holiday sales per day as drivers."""
    sales = fx.sales(spark, d)
    flags = sales.groupBy(F.col("product").alias("series_key"), F.col("sale_date").alias("ds")).agg(
        F.avg((F.col("promo") == "Oui").cast("double")).alias("promo"),
        F.avg((F.col("holiday") == "Yes").cast("double")).alias("holiday"),
    )
    daily = _series(spark, d).join(flags, ["series_key", "ds"], "left").na.fill(0.0, ["promo", "holiday"])
    return _bounded(fleet.forecast_fleet(daily, "decomposable", H), "model")


@query("trend_change_points", oracle(S + "SELECT series_key, true AS few, true AS within FROM line"))
def trend_change_points(spark, d):
    """Change points of each product's trend: few, and in the first part of its days."""
    daily = _series(spark, d)
    days = daily.groupBy("series_key").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    found = daily.select("series_key").distinct().join(fleet.change_points(daily), "series_key", "left").join(days, "series_key")
    place = F.datediff("ds", "first") <= F.datediff("last", "first") * fleet.CHANGE_RANGE + 1
    return found.groupBy("series_key").agg(
        (F.count("ds") <= fleet.CHANGE_POINTS).alias("few"),
        F.coalesce(F.min(place & (F.col("ds") > F.col("first"))), F.lit(True)).alias("within"),
    )


@query("backtest", oracle(S + "SELECT * FROM score", "mae rmse"))
def backtest(spark, d):
    return rounded(selection.backtest(_series(spark, d), SIMPLE))


def _tested(models):
    """SQL of a back-test's properties: a sound score of every model for every series."""
    names = ", ".join(f"('{m}')" for m in models)
    return oracle(S + f"SELECT series_key, model, true AS sound FROM line CROSS JOIN (VALUES {names}) m(model)")


def _sound(daily, scores):
    """Finite scores, MAE not above RMSE, and RMSE within ten times that of the training part's mean."""
    place = daily.select("series_key", "y", F.percent_rank().over(Window.partitionBy("series_key").orderBy("ds")).alias("p"))
    level = place.groupBy("series_key").agg(F.avg(F.when(F.col("p") < 0.8, F.col("y"))).alias("level"))
    rest = place.where("p >= 0.8").join(level, "series_key").groupBy("series_key").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("level"), F.lit(2.0)))).alias("plain"))
    good = (F.col("mae") >= 0) & (F.col("mae") <= F.col("rmse") * (1 + 1e-9)) & (F.col("rmse") <= 10 * F.col("plain"))
    return scores.join(rest, "series_key").select("series_key", "model", F.coalesce(good, F.lit(False)).alias("sound"))


RECURSIVE = ["holt_winters", "arima", "sarima", "decomposable"]
TREES = ["random_forest", "boosted_trees"]


@query("backtest_fleet", _tested(RECURSIVE))
def backtest_fleet(spark, d):
    daily = _series(spark, d)
    return _sound(daily, selection.backtest(daily, RECURSIVE))


@query("backtest_trees", _tested(TREES))
def backtest_trees(spark, d):
    daily = _series(spark, d)
    return _sound(daily, selection.backtest(daily, TREES))


@query("forecast_auto", oracle(S + "SELECT f.* FROM f JOIN best USING (series_key, model)", BOUNDS))
def auto(spark, d):
    return rounded(selection.forecast_auto(_series(spark, d), H, SIMPLE)[0])


@query("forecast_auto_fleet", _coming("", ["bounded", "least"]))
def auto_fleet(spark, d):
    """Choice among closed-form, recursive and tree models, with the scores of the chosen one."""
    daily = _series(spark, d)
    models = [*selection.DEFAULT_CANDIDATES, "smart_ma", "holt_winters"]
    ahead, choice, scores = selection.forecast_auto(daily, H, models)
    # Every series has one forecast, by the model with the least error among all of them.
    best = scores.groupBy("series_key").agg(F.min("mae").alias("best"), F.count(F.lit(1)).alias("n"))
    least = (F.col("mae") == F.col("best")) & (F.col("n") == len(models)) & F.col("chosen").isin(models)
    kept = choice.select("series_key", "mae", F.col("model").alias("chosen")).join(best, "series_key").select("series_key", "chosen", least.alias("least"))
    out = _bounded(ahead, "model").join(kept, "series_key")
    return out.select("series_key", "ds", "bounded", (F.col("least") & (F.col("model") == F.col("chosen"))).alias("least"))


@query("forecast_summary", oracle(S + """
    SELECT series_key, model, avg(yhat) AS mean, max(yhat) AS max, min(yhat) AS min, sum(yhat) AS total, max(hist_mean) AS hist_mean,
      (avg(yhat) / max(hist_mean) - 1) * 100 AS delta_pct FROM f JOIN hist USING (series_key) GROUP BY 1, 2""",
    "mean max min total hist_mean delta_pct"))
def summary(spark, d):
    daily = _series(spark, d)
    return rounded(scoring.forecast_summary(_simple_forecasts(daily), daily))


@query("reliability_score", oracle(S + """
    SELECT series_key, model, hist_std / hist_mean * 100 AS volatility, points, mae,
      greatest(0, least(100, round(100 - least(70, hist_std / hist_mean * 100) - CASE WHEN points < 60 THEN 12 ELSE 0 END
        - CASE WHEN model IN ('naive', 'smart_ma') THEN 8 ELSE 0 END - least(2, mae / hist_mean) * 40, 1))) AS reliability
    FROM score JOIN hist USING (series_key)""", "volatility mae reliability"))
def reliability(spark, d):
    daily = _series(spark, d)
    return rounded(scoring.reliability_score(selection.backtest(daily, SIMPLE), daily))


INSIGHTS = """SELECT series_key, model, (arg_max(yhat, ds) - arg_min(yhat, ds)) / arg_min(yhat, ds) * 100 AS trend,
    stddev_samp(yhat) / avg(yhat) * 100 AS volatility FROM f GROUP BY 1, 2"""


@query("forecast_insights", oracle(S + f"""
    SELECT *, CASE WHEN trend > 5 THEN 'up' WHEN trend < -5 THEN 'down' ELSE 'stable' END AS direction,
           CASE WHEN volatility > 20 THEN 'high' ELSE 'low' END AS risk FROM ({INSIGHTS})""", "trend volatility"))
def insights(spark, d):
    return rounded(scoring.forecast_insights(_simple_forecasts(_series(spark, d))))


@query("forecast_table", oracle(S + "SELECT series_key, model, strftime(ds, '%d/%m/%Y') AS date, round(yhat, 2) AS forecast FROM f", "forecast", 2))
def forecast_table(spark, d):
    return scoring.forecast_table(_simple_forecasts(_series(spark, d)))


@query("express_forecast", oracle("""
    WITH l AS (SELECT *, CAST(amount AS DOUBLE) AS y FROM sales
               ORDER BY sale_date DESC, order_id DESC, line_no DESC, part_id DESC, supp_id DESC LIMIT 30),
    c AS (SELECT y, (y - p) / nullif(p, 0) AS pct FROM (SELECT y, lag(y) OVER (ORDER BY sale_date, order_id, line_no, part_id, supp_id) AS p FROM l))
    SELECT avg(y) AS mean, avg(pct) AS trend, avg(y) * (1 + avg(pct)) * 30 AS next_month FROM c""", "mean trend next_month"))
def express(spark, d):
    return rounded(scoring.express_forecast(fx.sales(spark, d), fx.SPEC))


@query("forecast_calendar_forest", oracle("""
    SELECT product AS series_key, CAST(max(sale_date) + CAST(step AS INTEGER) AS DATE) AS ds, true AS bounded
    FROM sales CROSS JOIN (SELECT unnest(generate_series(1, 30)) AS step) GROUP BY product, step"""))
def calendar_forest(spark, d):
    daily = series.prepare_series(fx.sales(spark, d), fx.SPEC, ["product"], fill="zero")
    # Three calendar features and the series are told apart within about a dozen splits; the library default is MLlib's
    # limit of 30, which did not finish here in 110 s on a busy machine.
    ahead = trees.forecast_calendar_forest(daily, H, depth=12)
    return _bounded(ahead.withColumns({"lo": F.lit(0.0), "hi": F.lit(1e300)}))  # the model has no band


@query("driver_regression", oracle("""
    SELECT u.measure, u.value FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM sales
      WHERE amount IS NOT NULL AND unit_price IS NOT NULL AND promo IS NOT NULL AND stock IS NOT NULL AND marketing IS NOT NULL AND holiday IS NOT NULL),
      LATERAL (VALUES ('rows', n), ('importances', 1.0), ('drivers', 5.0), ('parts', 2.0), ('training part better than the mean', 1.0),
        ('test share near a fifth', 1.0)) u(measure, value)""", "value"))
def drivers(spark, d):
    _, importances, scores = trees.driver_regression(
        fx.sales(spark, d), "amount", "unit_price", "promo", "stock", "marketing", "holiday", fx.SPEC.order,
        depth=8)  # the library default is MLlib's limit; trees that deep did not finish in 170 s at sf0.01
    share = F.sum(F.when(F.col("test"), F.col("n"))) / F.sum("n")
    told = scores.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("parts"), F.count_if(~F.col("test") & (F.col("r2") > 0) & (F.col("mae") <= F.col("rmse"))).alias("good"),
        share.between(0.15, 0.25).alias("share"),
    )
    measures = {"rows": "rows", "parts": "parts", "training part better than the mean": "good", "test share near a fifth": "share"}
    one = told.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("value")) for m, c in measures.items()])))
    weights = importances.agg(F.sum("importance").alias("importances"), F.count(F.lit(1)).cast("double").alias("drivers"))
    return rounded(one.unionByName(weights.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("importances", "drivers")])))))


@query("history_and_forecast", oracle(S + """
    SELECT series_key, NULL::VARCHAR AS model, 'history' AS kind, ds, y AS value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM s
    UNION ALL SELECT series_key, model, 'forecast', ds, yhat, lo, hi FROM f""", "value lo hi"))
def history(spark, d):
    daily = _series(spark, d)
    return rounded(scoring.history_and_forecast(_simple_forecasts(daily), daily))


@query("forecast_report", oracle(S + f""",
    st AS (SELECT series_key, model, avg(yhat) AS mean, max(yhat) AS max, min(yhat) AS min, sum(yhat) AS total FROM f GROUP BY 1, 2),
    ins AS ({INSIGHTS}),
    r AS (SELECT series_key, model, 1 AS section_no, 'statistics' AS section, u.position, u.label, NULL::VARCHAR AS detail, u.value
          FROM (SELECT st.*, trend, volatility FROM st JOIN ins USING (series_key, model)) x, LATERAL (VALUES (1, 'mean', mean),
            (2, 'max', max), (3, 'min', min), (4, 'total', total), (5, 'trend', trend), (6, 'volatility', volatility)) u(position, label, value)
      UNION ALL SELECT series_key, model, 2, 'history', 1, 'hist_mean', NULL, hist_mean FROM st JOIN hist USING (series_key)
      UNION ALL SELECT series_key, model, 2, 'history', 2, 'points', NULL, CAST(points AS DOUBLE) FROM st JOIN hist USING (series_key)
      UNION ALL SELECT series_key, model, 3, 'forecast', CAST(row_number() OVER (PARTITION BY series_key, model ORDER BY ds) AS INTEGER),
        'day', strftime(ds, '%d/%m/%Y'), round(yhat, 2) FROM f)
    SELECT * FROM r WHERE section <> 'forecast' OR model IS NOT NULL""", "value"))
def report(spark, d):
    daily = _series(spark, d)
    return rounded(forecast_report(_simple_forecasts(daily), daily))
