"""Moving averages, lag, change, fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.registry import ORDER, oracle, query, rounded
from tidemark.forecasting.series import prepare_series
from tidemark.operators import windows as win

DAILY = "SELECT sale_date AS date, CAST(sum(amount) AS DOUBLE) AS value FROM sales GROUP BY 1"
DAILY_BY = "SELECT product, sale_date AS date, CAST(sum(amount) AS DOUBLE) AS value FROM sales GROUP BY 1, 2"


def _frame(n, order, by=""):
    return f"OVER ({by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _strict(value, n, order, by=""):
    frame = _frame(n, order, by)
    return f"CASE WHEN count({value}) {frame} >= {n} THEN avg({value}) {frame} END AS ma_{n}"


@query("moving_average", oracle(f"""
    SELECT date, value, {_strict('value', 7, 'date')}, {_strict('value', 30, 'date')} FROM ({DAILY})""", "value ma_7 ma_30"))
def moving_average(spark, d):
    return rounded(win.moving_average(fx.sales(spark, d), fx.SPEC))


@query("moving_average_rows", oracle(f"""
    SELECT o_orderkey, {_strict('o_totalprice', 7, 'o_orderdate, o_orderkey')},
           {_strict('o_totalprice', 30, 'o_orderdate, o_orderkey')} FROM orders""", "ma_7 ma_30"))
def moving_average_rows(spark, d):
    return rounded(win.moving_average_rows(fx.table(spark, d, "orders"), fx.ORDERS_SPEC).select("o_orderkey", "ma_7", "ma_30"))


@query("moving_average_rows_buckets", oracle(f"""
    SELECT o_orderkey, {_strict('o_totalprice', 7, 'o_orderdate, o_orderkey')},
           {_strict('o_totalprice', 30, 'o_orderdate, o_orderkey')} FROM orders""", "ma_7 ma_30"))
def moving_average_rows_buckets(spark, d):
    """The same over many range buckets, as on a long table."""
    out = win.moving_average_rows(fx.table(spark, d, "orders"), fx.ORDERS_SPEC, rows_per_bucket=400)
    return rounded(out.select("o_orderkey", "ma_7", "ma_30"))


@query("moving_average_partial", oracle("SELECT product, date, value, " + ", ".join(
    f"avg(value) {_frame(n, 'date', 'PARTITION BY product')} AS ma_{n}" for n in (7, 14, 30)) + f" FROM ({DAILY_BY})",
    "value ma_7 ma_14 ma_30"))
def moving_average_partial(spark, d):
    return rounded(win.moving_average_partial(fx.sales(spark, d), fx.SPEC, by=["product"]))


@query("lag_feature", oracle(f"""
    SELECT product, date, value, coalesce(lag(value) OVER (PARTITION BY product ORDER BY date), value) AS lag_1
    FROM ({DAILY_BY})""", "value lag_1"))
def lag_feature(spark, d):
    return rounded(win.lag_feature(fx.sales(spark, d), fx.SPEC, ["product"]))


@query("pct_change", oracle(f"""
    SELECT {ORDER}, product, (v - p) / nullif(p, 0) AS pct_change, coalesce(p = 0, false) AS zero_base
    FROM (SELECT *, lag(v) OVER (PARTITION BY product ORDER BY {ORDER}) AS p FROM (
      SELECT *, coalesce(x, last_value(x IGNORE NULLS) OVER (PARTITION BY product ORDER BY {ORDER}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v
      FROM (SELECT *, CASE WHEN order_id % 9 <> 0 THEN CAST(amount AS DOUBLE) END AS x FROM sales)))""", "pct_change", 6))
def pct_change(spark, d):
    # Some values are taken out, so that the fill is exercised.
    kept = F.when(F.col("order_id") % 9 != 0, F.col("amount")).alias("amount")
    holes = fx.sales(spark, d).select(*fx.SPEC.order, "product", kept)
    out = win.pct_change(holes, fx.SPEC, ["product"])
    return rounded(out.select(*fx.SPEC.order, "product", "pct_change", "zero_base"), 6)


@query("forward_fill", oracle(f"""
    WITH t AS ({DAILY_BY}),
    c AS (SELECT product, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS ds FROM t GROUP BY 1)
    SELECT c.product AS series_key, ds, last_value(value IGNORE NULLS) OVER (PARTITION BY c.product ORDER BY ds
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
    FROM c LEFT JOIN t ON t.product = c.product AND t.date = c.ds""", "y"))
def forward_fill(spark, d):
    return rounded(prepare_series(fx.sales(spark, d), fx.SPEC, ["product"]))
