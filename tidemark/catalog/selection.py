"""Filters, projection, selection, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.registry import ORDER, oracle, query, rounded
from tidemark.functions.numeric import mean, total
from tidemark.operators import filters

KEYS = "sale_date, order_id, line_no, part_id, supp_id, product, region, CAST(amount AS DOUBLE) AS amount"


def _rows(df):
    return rounded(df.select("sale_date", "order_id", "line_no", "part_id", "supp_id", "product", "region",
                             F.col("amount").cast("double").alias("amount")))


@query("filter_period", oracle(f"""
    SELECT {KEYS} FROM sales WHERE sale_date BETWEEN DATE '1997-03-01' AND DATE '1998-06-30'""", "amount"))
def period(spark, d):
    return _rows(filters.filter_sales(fx.sales(spark, d), fx.SPEC, "1997-03-01", "1998-06-30"))


@query("filter_categories", oracle(f"SELECT {KEYS} FROM sales WHERE product IN ('SMALL', 'PROMO')", "amount"))
def categories(spark, d):
    return _rows(filters.filter_sales(fx.sales(spark, d), fx.SPEC, cats=["SMALL", "PROMO"]))


@query("filter_regions", oracle(f"""
    SELECT {KEYS} FROM sales WHERE region IN ('ASIA', 'EUROPE') AND product IN ('SMALL') AND sale_date >= DATE '1996-01-01'""", "amount"))
def regions(spark, d):
    return _rows(filters.filter_sales(fx.sales(spark, d), fx.SPEC, "1996-01-01", None, ["SMALL"], ["ASIA", "EUROPE"]))


@query("filter_equals", oracle("""
    SELECT product, CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(amount) AS DOUBLE) / count(amount) AS mean
    FROM sales WHERE promo = 'Oui' AND region = 'ASIA' GROUP BY 1""", "total mean"))
def equals(spark, d):
    out = filters.filter_equals(filters.filter_equals(fx.sales(spark, d), "promo", "Oui"), "region", "ASIA")
    return rounded(out.groupBy("product").agg(total("amount").alias("total"), mean("amount").alias("mean")))


@query("first_values", oracle(f"""
    SELECT product, CAST(row_number() OVER (ORDER BY seen, product) AS INTEGER) AS position
    FROM (SELECT product, min(ROW({ORDER})) AS seen FROM sales GROUP BY 1 ORDER BY 2, 1 LIMIT 5)"""))
def first(spark, d):
    return filters.first_values(fx.sales(spark, d), fx.SPEC, "product", 5)


@query("distinct_values", oracle("SELECT DISTINCT brand FROM sales WHERE brand IS NOT NULL"))
def distinct(spark, d):
    return filters.distinct_values(fx.sales(spark, d), "brand")


@query("date_bounds", oracle("""
    SELECT min(sale_date) AS first_date, max(sale_date) AS last_date, count(*) AS "rows",
           CAST(max(sale_date) - min(sale_date) AS INTEGER) AS span_days FROM sales"""))
def bounds(spark, d):
    return filters.date_bounds(fx.sales(spark, d), fx.SPEC)


@query("top_rows", oracle(f"SELECT {KEYS} FROM sales ORDER BY sales.amount DESC NULLS LAST, {ORDER} LIMIT 50", "amount"))
def top(spark, d):
    return _rows(filters.top_rows(fx.sales(spark, d), "amount", 50, fx.SPEC.order))


@query("last_rows", oracle(f"""
    SELECT {KEYS} FROM sales QUALIFY row_number() OVER (PARTITION BY product ORDER BY
      sale_date DESC, order_id DESC, line_no DESC, part_id DESC, supp_id DESC) <= 30""", "amount"))
def last(spark, d):
    return _rows(filters.last_rows(fx.sales(spark, d), fx.SPEC, 30, ["product"]))


@query("last_rows_many", oracle(f"""
    SELECT {KEYS} FROM (SELECT *, nullif(promo, 'Non') AS g FROM sales) QUALIFY row_number() OVER (PARTITION BY g ORDER BY
      sale_date DESC, order_id DESC, line_no DESC, part_id DESC, supp_id DESC) <= 20000""", "amount"))
def last_many(spark, d):
    """Many rows of two large groups, one of them without a name, over buckets much smaller than either."""
    rows = fx.sales(spark, d).withColumn("g", F.nullif("promo", F.lit("Non")))
    return _rows(filters.last_rows(rows, fx.SPEC, 20_000, ["g"], rows_per_bucket=3_000))


@query("latest_value", oracle(f"""
    SELECT product, arg_max(CAST(amount AS DOUBLE), ROW({ORDER})) AS last_amount FROM sales GROUP BY 1""", "last_amount"))
def latest(spark, d):
    out = filters.latest_value(fx.sales(spark, d), fx.SPEC, "amount", ["product"])
    return rounded(out.withColumn("last_amount", F.col("last_amount").cast("double")))


@query("series_points_raw", oracle("SELECT sale_date, product, quantity, stock FROM sales", "quantity stock"))
def raw_points(spark, d):
    return rounded(filters.series_points(fx.sales(spark, d), fx.SPEC, ["quantity", "stock"])).select("sale_date", "product", "quantity", "stock")


@query("series_points", oracle("""
    SELECT CAST(date_trunc('week', sale_date) AS DATE) AS date, product, CAST(sum(amount) AS DOUBLE) AS amount, sum(stock) AS stock
    FROM sales GROUP BY 1, 2""", "amount stock"))
def points(spark, d):
    return rounded(filters.series_points(fx.sales(spark, d), fx.SPEC, ["amount", "stock"], "week"))
