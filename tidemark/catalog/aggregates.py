"""KPIs, grouped aggregates, statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.registry import ORDER, oracle, query, rounded
from tidemark.operators import aggregates as agg
from tidemark.operators import profiles, stats
from tidemark.plans.stages import stored

D = "CAST(amount AS DOUBLE)"
TOTAL = "CAST(sum(amount) AS DOUBLE)"
MEAN = f"{TOTAL} / count(amount)"
NUMBERS = ["amount", "quantity", "unit_price", "marketing", "stock"]
CHANGES = f"""SELECT *, ({D} - p) / nullif(p, 0) AS pct, CASE WHEN p = 0 THEN 1 ELSE 0 END AS zero
    FROM (SELECT *, lag({D}) OVER ({{by}} ORDER BY {ORDER}) AS p FROM sales)"""
GLOBAL_CHANGES = CHANGES.format(by="")
CATEGORY_CHANGES = CHANGES.format(by="PARTITION BY product")
GROWTH = "avg(pct) * 100 AS growth, CAST(sum(zero) AS BIGINT) AS n_zero_base"


@query("kpi_summary", oracle(f"""
    SELECT {TOTAL} AS total, {MEAN} AS mean, count(DISTINCT product) AS categories, count(*) AS entries,
           stddev_samp({D}) AS std, quantile_cont({D}, 0.5) AS median FROM sales""", "total mean std median"))
def kpis(spark, d):
    return rounded(agg.kpi_summary(fx.sales(spark, d), fx.SPEC))


@query("growth_mean", oracle(f"SELECT {GROWTH} FROM ({GLOBAL_CHANGES})", "growth"))
def growth(spark, d):
    return rounded(agg.growth_mean(fx.sales(spark, d), fx.SPEC))


@query("growth_mean_buckets", oracle(f"SELECT {GROWTH} FROM ({GLOBAL_CHANGES})", "growth"))
def growth_buckets(spark, d):
    """The same over many range buckets, as on a long table."""
    return rounded(agg.growth_mean(fx.sales(spark, d), fx.SPEC, rows_per_bucket=1500))


# NaN is a missing value: SQL over NULL must give the same.
HOLES = f"FROM (SELECT * REPLACE (CASE WHEN order_id % 7 <> 0 THEN {D} END AS amount) FROM sales)"


def _holes(spark, d):
    amount = F.when(F.col("order_id") % 7 == 0, float("nan")).otherwise(F.col("amount").cast("double"))
    return fx.sales(spark, d).withColumn("amount", amount)


@query("kpi_summary_nan", oracle(f"""
    SELECT {TOTAL} AS total, {MEAN} AS mean, count(DISTINCT product) AS categories, count(*) AS entries,
           stddev_samp({D}) AS std, quantile_cont({D}, 0.5) AS median {HOLES}""", "total mean std median"))
def kpis_nan(spark, d):
    return rounded(agg.kpi_summary(_holes(spark, d), fx.SPEC))


@query("describe_columns_nan", oracle(f"""
    SELECT 'amount' AS "column", count(amount) AS count, avg(amount) AS mean, stddev_samp(amount) AS std, min(amount) AS min,
      max(amount) AS max, quantile_cont(amount, 0.25) AS p25, quantile_cont(amount, 0.5) AS p50, quantile_cont(amount, 0.75) AS p75
    {HOLES}""", "mean std min max p25 p50 p75"))
def describe_nan(spark, d):
    return rounded(stats.describe_columns(_holes(spark, d), ["amount"]))


@query("histogram_nan", oracle(f"""
    WITH v AS (SELECT amount AS x {HOLES}), m AS (SELECT min(x) AS a, max(x) AS b FROM v),
    c AS (SELECT CAST(least(floor((x - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM v CROSS JOIN m WHERE x IS NOT NULL GROUP BY 1)
    SELECT CAST(g AS INTEGER) AS bin, a + g * ((b - a) / 20) AS lower, a + (g + 1) * ((b - a) / 20) AS upper, coalesce(n, 0) AS frequency
    FROM m CROSS JOIN generate_series(0, 19) t(g) LEFT JOIN c ON c.bin = g""", "lower upper"))
def histogram_nan(spark, d):
    return rounded(stats.histogram(_holes(spark, d), "amount", 20))


@query("box_stats_nan", oracle(f"""
    WITH h AS (SELECT product, amount AS x {HOLES}),
    q AS (SELECT product, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM h GROUP BY 1),
    j AS (SELECT q.*, x, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM h JOIN q USING (product) WHERE x IS NOT NULL)
    SELECT product, q1, median, q3, min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
           avg(x) AS mean, stddev_samp(x) AS std, count(*) FILTER (NOT inside) AS outliers
    FROM j GROUP BY 1, 2, 3, 4""", "q1 median q3 whisker_low whisker_high mean std"))
def box_nan(spark, d):
    return rounded(stats.box_stats(_holes(spark, d), "amount", "product"))


@query("daily_totals", oracle(f"""
    WITH t AS (SELECT product, sale_date AS date, {TOTAL} AS value FROM sales GROUP BY 1, 2),
    c AS (SELECT product, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM t GROUP BY 1)
    SELECT product, date, coalesce(value, 0) AS value FROM c LEFT JOIN t USING (product, date)""", "value"))
def daily(spark, d):
    return rounded(agg.daily_totals(fx.sales(spark, d), fx.SPEC, ["product"], fill="zero"))


@query("category_performance", oracle(f"""
    SELECT product, {TOTAL} AS total, {MEAN} AS mean, max({D}) AS max, min({D}) AS min, {GROWTH}
    FROM ({CATEGORY_CHANGES}) GROUP BY 1""", "total mean max min growth"))
def performance(spark, d):
    return rounded(agg.category_performance(fx.sales(spark, d), fx.SPEC))


@query("region_kpis", oracle(f"""
    SELECT region, {TOTAL} AS total, {MEAN} AS mean, {TOTAL} / (SELECT {TOTAL} FROM sales) * 100 AS share
    FROM sales GROUP BY 1""", "total mean share"))
def region_kpis(spark, d):
    return rounded(agg.region_kpis(fx.sales(spark, d), fx.SPEC))


@query("region_by_category", oracle(f"SELECT region, product, {TOTAL} AS total FROM sales GROUP BY 1, 2", "total"))
def region_by_category(spark, d):
    return rounded(agg.region_by_category(fx.sales(spark, d), fx.SPEC))


@query("region_comparison", oracle(f"""
    SELECT region, {TOTAL} AS total, {MEAN} AS mean, count(amount) AS transactions FROM sales GROUP BY 1""", "total mean"))
def region_comparison(spark, d):
    return rounded(agg.region_comparison(fx.sales(spark, d), fx.SPEC))


@query("promo_stats", oracle(f"""
    SELECT p.promo, coalesce({TOTAL}, 0) AS total, coalesce({MEAN}, 0) AS mean, count(amount) AS transactions
    FROM (VALUES ('Oui'), ('Non')) p(promo) LEFT JOIN sales s ON s.promo = p.promo GROUP BY 1""", "total mean"))
def promo_stats(spark, d):
    return rounded(agg.promo_stats(fx.sales(spark, d), fx.SPEC))


WITH_PROMO = "CAST(sum(amount) FILTER (promo = 'Oui') AS DOUBLE) / count(amount) FILTER (promo = 'Oui')"
NO_PROMO = "CAST(sum(amount) FILTER (promo = 'Non') AS DOUBLE) / count(amount) FILTER (promo = 'Non')"


@query("promo_lift", oracle(f"""
    SELECT *, CASE WHEN lift IS NULL THEN 'not computable' WHEN lift > 20 THEN 'very effective' WHEN lift > 0 THEN 'moderate'
                   ELSE 'weak or negative' END AS verdict
    FROM (SELECT *, CASE WHEN mean_without > 0 THEN (mean_with - mean_without) / mean_without * 100 END AS lift
          FROM (SELECT product, {WITH_PROMO} AS mean_with, {NO_PROMO} AS mean_without FROM sales GROUP BY 1))""",
    "mean_with mean_without lift"))
def promo_lift(spark, d):
    return rounded(agg.promo_lift(fx.sales(spark, d), fx.SPEC, ["product"]))


@query("promo_weekly", oracle(f"""
    WITH w AS (SELECT CAST(sale_date + CAST(7 - isodow(sale_date) AS INTEGER) AS DATE) AS week, {WITH_PROMO} AS mean_with,
                      {NO_PROMO} AS mean_without FROM sales GROUP BY 1),
    c AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w)
    SELECT week, mean_with, mean_without FROM c LEFT JOIN w USING (week)""", "mean_with mean_without"))
def promo_weekly(spark, d):
    return rounded(agg.promo_weekly(fx.sales(spark, d), fx.SPEC))


@query("stock_status", oracle(f"""
    SELECT *, (stock - mean_stock) / nullif(mean_stock, 0) * 100 AS variation,
           CASE WHEN stock < mean_stock * 0.3 THEN 'critical' WHEN stock < mean_stock * 0.5 THEN 'low' ELSE 'ok' END AS level
    FROM (SELECT product, arg_max(stock, ROW({ORDER})) AS stock, avg(stock) AS mean_stock FROM sales GROUP BY 1)""",
    "stock mean_stock variation"))
def stock_status(spark, d):
    return rounded(agg.stock_status(fx.sales(spark, d), fx.SPEC))


@query("stock_correlation", oracle(f"""
    SELECT r AS correlation, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
    FROM (SELECT corr(stock, {D}) AS r FROM sales)""", "correlation", 6))
def stock_correlation(spark, d):
    return rounded(agg.stock_correlation(fx.sales(spark, d), fx.SPEC), 6)


@query("monthly_profile", oracle(f"""
    SELECT 'mean' AS measure, CAST(month(sale_date) AS INTEGER) AS month, {MEAN} AS value FROM sales GROUP BY 2
    UNION ALL SELECT 'sum', CAST(month(sale_date) AS INTEGER), {TOTAL} FROM sales GROUP BY 2""", "value"))
def monthly(spark, d):
    s = fx.sales(spark, d)
    parts = [profiles.monthly_profile(s, fx.SPEC, m).withColumn("measure", F.lit(m)) for m in ("mean", "sum")]
    return rounded(parts[0].unionByName(parts[1]))


@query("weekday_profile", oracle(f"""
    SELECT CAST(isodow(sale_date) - 1 AS INTEGER) AS weekday, {MEAN} AS value FROM sales GROUP BY 1""", "value"))
def weekday(spark, d):
    return rounded(profiles.weekday_profile(fx.sales(spark, d), fx.SPEC))


MONTHS = [f"m{m}" for m in range(1, 13)]


@query("season_heatmap", oracle("SELECT CAST(day(sale_date) AS INTEGER) AS day, " + ", ".join(
    f"CAST(sum(amount) FILTER (month(sale_date) = {m}) AS DOUBLE) / count(amount) FILTER (month(sale_date) = {m}) AS m{m}"
    for m in range(1, 13)) + " FROM sales GROUP BY 1", " ".join(MONTHS)))
def heatmap(spark, d):
    return rounded(profiles.season_heatmap(fx.sales(spark, d), fx.SPEC))


@query("season_extremes", oracle(f"""
    SELECT *, (best_value / worst_value - 1) * 100 AS gap FROM (
      SELECT period, arg_max(k, ROW(v, -k)) AS best, max(v) AS best_value, arg_min(k, ROW(v, k)) AS worst, min(v) AS worst_value
      FROM (SELECT 'month' AS period, CAST(month(sale_date) AS INTEGER) AS k, {MEAN} AS v FROM sales GROUP BY 2
            UNION ALL SELECT 'weekday', CAST(isodow(sale_date) - 1 AS INTEGER), {MEAN} FROM sales GROUP BY 2)
      GROUP BY 1)""", "best_value worst_value gap"))
def extremes(spark, d):
    return rounded(profiles.season_extremes(fx.sales(spark, d), fx.SPEC))


@query("describe_columns", oracle(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
        quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM sales)""" for c in NUMBERS), "mean std min max p25 p50 p75"))
def describe(spark, d):
    return rounded(stats.describe_columns(fx.sales(spark, d), NUMBERS))


@query("describe_columns_buckets", oracle(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
        quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM sales)""" for c in NUMBERS), "mean std min max p25 p50 p75"))
def describe_buckets(spark, d):
    """Over a plain table, which every pass of the quantiles scans."""
    return rounded(stats.describe_columns(stored(fx.sales(spark, d).select(*NUMBERS), "plain"), NUMBERS))


@query("histogram", oracle(f"""
    WITH v AS (SELECT {D} AS x FROM sales), m AS (SELECT min(x) AS a, max(x) AS b FROM v),
    c AS (SELECT CAST(least(floor((x - a) / ((b - a) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM v CROSS JOIN m GROUP BY 1)
    SELECT CAST(g AS INTEGER) AS bin, a + g * ((b - a) / 50) AS lower, a + (g + 1) * ((b - a) / 50) AS upper,
           coalesce(n, 0) AS frequency
    FROM m CROSS JOIN generate_series(0, 49) t(g) LEFT JOIN c ON c.bin = g""", "lower upper"))
def histogram(spark, d):
    return rounded(stats.histogram(fx.sales(spark, d), "amount", 50))


@query("box_stats", oracle(f"""
    WITH q AS (SELECT product, quantile_cont({D}, 0.25) AS q1, quantile_cont({D}, 0.5) AS median, quantile_cont({D}, 0.75) AS q3
               FROM sales GROUP BY 1),
    j AS (SELECT q.*, {D} AS x, {D} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM sales JOIN q USING (product))
    SELECT product, q1, median, q3, min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
           avg(x) AS mean, stddev_samp(x) AS std, count(*) FILTER (NOT inside) AS outliers
    FROM j GROUP BY 1, 2, 3, 4""", "q1 median q3 whisker_low whisker_high mean std"))
def box(spark, d):
    return rounded(stats.box_stats(fx.sales(spark, d), "amount", "product"))


@query("box_stats_buckets", oracle(f"""
    WITH q AS (SELECT product, quantile_cont({D}, 0.25) AS q1, quantile_cont({D}, 0.5) AS median, quantile_cont({D}, 0.75) AS q3
               FROM sales GROUP BY 1),
    j AS (SELECT q.*, {D} AS x, {D} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM sales JOIN q USING (product))
    SELECT product, q1, median, q3, min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
           avg(x) AS mean, stddev_samp(x) AS std, count(*) FILTER (NOT inside) AS outliers
    FROM j GROUP BY 1, 2, 3, 4""", "q1 median q3 whisker_low whisker_high mean std"))
def box_buckets(spark, d):
    """Over a plain table, which every pass of the quantiles scans."""
    return rounded(stats.box_stats(stored(fx.sales(spark, d).select("amount", "product"), "plain"), "amount", "product"))


CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS correlation FROM sales"
    for a, b in combinations(NUMBERS, 2))


@query("corr_matrix", oracle(f"""
    WITH p AS ({CORRELATIONS}) SELECT * FROM p UNION ALL SELECT column_b, column_a, correlation FROM p
    UNION ALL SELECT c, c, 1.0::DOUBLE FROM (VALUES {', '.join(f"('{c}')" for c in NUMBERS)}) t(c)""", "correlation", 6))
def correlations(spark, d):
    return rounded(stats.corr_matrix(fx.sales(spark, d), NUMBERS), 6)


@query("top_correlations", oracle(f"""
    SELECT column_a, column_b, correlation, sign, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY sign ORDER BY round(abs(correlation), 12) DESC, column_a, column_b) AS rank
      FROM (SELECT *, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS sign
            FROM ({CORRELATIONS}) WHERE correlation <> 0)) WHERE rank <= 5""", "correlation", 6))
def top_correlations(spark, d):
    return rounded(stats.top_correlations(fx.sales(spark, d), NUMBERS), 6)


@query("ols_trend", oracle(f"""
    SELECT product, regr_slope({D}, quantity) AS slope, regr_intercept({D}, quantity) AS intercept, regr_r2({D}, quantity) AS r2,
           CAST(regr_count({D}, quantity) AS BIGINT) AS n FROM sales GROUP BY 1""", "slope intercept r2"))
def ols(spark, d):
    return rounded(stats.ols_trend(fx.sales(spark, d), "quantity", "amount", ["product"]))


@query("top_bottom_categories", oracle(f"""
    WITH t AS (SELECT brand, {TOTAL} AS total FROM sales GROUP BY 1)
    SELECT brand, total, CAST(row_number() OVER (ORDER BY total DESC, brand) AS INTEGER) AS rank, 'top' AS side FROM t
    QUALIFY rank <= 5
    UNION ALL SELECT brand, total, CAST(row_number() OVER (ORDER BY total, brand) AS INTEGER) AS rank, 'bottom' FROM t
    QUALIFY rank <= 5""", "total"))
def top_bottom(spark, d):
    return rounded(agg.top_bottom_categories(fx.sales(spark, d), fx.BRAND_SPEC))


@query("audit_stats", oracle("""
    SELECT (SELECT count(*) FROM contacts) AS users, (SELECT count(*) FROM orders) AS demos, count(*) AS logins,
           count(*) FILTER (event_type <> 'error') AS login_success FROM events"""))
def audit_stats(spark, d):
    return agg.audit_stats(fx.logins(spark, d), fx.contacts(spark, d), fx.table(spark, d, "orders"))


@query("audit_latest", oracle("""
    SELECT event_id, user_id, ts AS created_at, event_type <> 'error' AS success, substr(props, 1, 6) AS user_agent
    FROM events ORDER BY ts DESC, event_id LIMIT 500"""))
def audit_latest(spark, d):
    columns = ["event_id", "user_id", "created_at", "success", "user_agent"]
    return agg.audit_latest(fx.logins(spark, d), columns, cut={"user_agent": 6})


@query("category_insights", oracle(f"""
    SELECT *, coalesce(total / (SELECT {TOTAL} FROM sales) * 100, 0) AS share,
           CASE WHEN cv < 20 THEN 'Excellent' WHEN cv < 40 THEN 'Bon' ELSE 'Volatile' END AS stability,
           CAST(row_number() OVER (ORDER BY total DESC, product) AS INTEGER) AS rank
    FROM (SELECT *, round(std / nullif(mean, 0) * 100, 2) AS cv FROM (
      SELECT product, round({TOTAL}, 2) AS total, round({MEAN}, 2) AS mean, round(stddev_samp({D}), 2) AS std FROM sales GROUP BY 1))
    QUALIFY rank <= 3""", "total mean std cv share"))
def insights(spark, d):
    return rounded(agg.category_insights(fx.sales(spark, d), fx.SPEC))


@query("growth_potential", oracle(f"""
    WITH t AS (SELECT product, round({TOTAL}, 2) AS total, round({MEAN}, 2) AS mean FROM sales GROUP BY 1),
    p AS (SELECT *, coalesce(((SELECT avg(mean) FROM t) - mean) / nullif(mean, 0) * 100, 0) AS potential,
                 CAST(row_number() OVER (ORDER BY total, product) AS INTEGER) AS rank FROM t)
    SELECT *, CASE WHEN potential > 50 THEN 'Promouvoir' WHEN potential > 20 THEN 'Optimiser' ELSE 'Surveiller' END AS action
    FROM p WHERE rank <= 3""", "total mean potential"))
def potential(spark, d):
    return rounded(agg.growth_potential(fx.sales(spark, d), fx.SPEC))


@query("growth_verdict", oracle(f"""
    SELECT *, CASE WHEN growth > 5 THEN 'strong' WHEN growth > 0 THEN 'moderate' ELSE 'attention' END AS verdict
    FROM (SELECT {GROWTH} FROM ({GLOBAL_CHANGES}))""", "growth"))
def verdict(spark, d):
    return rounded(agg.growth_verdict(fx.sales(spark, d), fx.SPEC))


@query("user_lookup", oracle("SELECT * FROM contacts WHERE email = 'client101@shop.ma'"))
def one_user(spark, d):
    return agg.user_lookup(fx.contacts(spark, d), "client101@shop.ma").select("contact_id", "c_name", "email", "phone")


@query("users_known", oracle("""
    SELECT c.* FROM contacts c WHERE email IN (SELECT DISTINCT concat('client', CAST(o_custkey AS VARCHAR), '@shop.ma') FROM orders
      WHERE o_orderstatus = 'F')"""))
def lookup(spark, d):
    wanted = fx.table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("client"), F.col("o_custkey").cast("string"), F.lit("@shop.ma")).alias("email"))
    return agg.users_known(fx.contacts(spark, d), wanted).select("contact_id", "c_name", "email", "phone")
