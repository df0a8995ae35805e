"""Sales, contacts and audit views over star-schema parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.spec import SalesSpec

SPEC = SalesSpec(
    date_col="sale_date",
    target_col="amount",
    cat_col="product",
    order_by=("order_id", "line_no", "part_id", "supp_id"),
    region_col="region",
    promo_col="promo",
    stock_col="stock",
)
BRAND_SPEC = SalesSpec("sale_date", "amount", "brand", SPEC.order_by, "region", "promo", "stock")
ORDERS_SPEC = SalesSpec("o_orderdate", "o_totalprice", "o_orderstatus", ("o_orderkey",))
EVENTS_SPEC = SalesSpec("ts", "value", "event_type", ("event_id",))


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; its schema is read from the footer once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with product, region, promotion, stock, holiday and weather."""
    read = lambda name: table(spark, sf_dir, name)
    joined = (
        read("lineitem")
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    late_december = (F.month("l_shipdate") == 12) & (F.day("l_shipdate") >= 24)
    return joined.select(
        F.col("l_shipdate").cast("date").alias("sale_date"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("p_type").alias("product"),
        F.col("p_brand").alias("brand"),
        F.col("r_name").alias("region"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amount"),
        F.col("l_quantity").alias("quantity"),
        F.col("p_retailprice").alias("unit_price"),
        (F.col("l_tax") * 10000).alias("marketing"),
        (F.col("l_quantity") * 10).alias("stock"),
        F.when(F.col("l_discount") >= 0.05, "Oui").otherwise("Non").alias("promo"),
        F.when(late_december, "Yes").otherwise("No").alias("holiday"),
        F.when(F.col("l_returnflag") == "A", "Sunny").when(F.col("l_returnflag") == "N", "Rain").otherwise("Cloud").alias("weather"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with e-mail addresses and phone numbers, some of them malformed."""
    key = F.col("c_custkey")
    text = key.cast("string")
    return table(spark, sf_dir, "customer").select(
        key.alias("contact_id"),
        "c_name",
        F.when(key % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("client"), text, F.lit("@shop.ma"))).alias("email"),
        F.when(key % 7 == 0, "12345").otherwise(F.concat(F.lit("+2126"), F.lpad(text, 8, "0"))).alias("phone"),
    )


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as log-in attempts."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("success"),
        F.col("props").alias("user_agent"),
    )
