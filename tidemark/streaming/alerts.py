"""Threshold alerts on arriving records.

Daily totals per category are compared with the day before that has records. A day counts as closed when the
watermark has passed its end; later records for it are dropped, so its alerts are final. Days that are still open
are reported as they stand after each micro-batch, also when the source ends; the next batch replaces these
reports. Every micro-batch writes its output and its state under its own number, so a batch that is run again
after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.alerts import WHOLE, breaches, variations

ALERTS = "category string, ds date, variation double, label string, batch_id bigint"
# Totals of open days, and of the last closed day of every category: what the next batch can still need.
STATE = "category string, ds date, y double, seen timestamp, whole boolean, closed boolean"


def daily_stream(stream: DataFrame, time: str, category: str, value: str, delay: str = "1 day") -> DataFrame:
    """Daily totals ``(category, ds, y, seen)`` of a stream, with the latest time of a record: each batch has the
    days that it changed. Totals are added up map-side before the shuffle."""
    timed = stream.select(F.col(time).cast("timestamp").alias("_time"), F.col(category).alias("category"), F.col(value).cast("double").alias("_v"))
    daily = timed.withWatermark("_time", delay).groupBy(F.window("_time", "1 day"), "category").agg(
        F.sum("_v").alias("y"), F.max("_time").alias("seen")
    )
    return daily.select("category", F.col("window.start").cast("date").alias("ds"), F.coalesce("y", F.lit(0.0)).alias("y"), "seen")


def _merged(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """All days that were open before this batch as they are after it, and closed days to compare with."""
    parts = batch.withColumn("_new", F.lit(True))
    if before is not None:
        parts = parts.unionByName(before.where("NOT whole AND NOT closed").drop("whole", "closed").withColumn("_new", F.lit(False)))
    parts = parts.groupBy("category", "ds").agg(F.max_by("y", "_new").alias("y"), F.max("seen").alias("seen"))
    total = parts.groupBy("ds").agg(F.sum("y").alias("y"), F.max("seen").alias("seen")).withColumn("category", F.lit(WHOLE))
    both = parts.withColumn("whole", F.lit(False)).unionByName(total.withColumn("whole", F.lit(True))).withColumn("known", F.lit(False))
    if before is not None:
        both = both.unionByName(before.where("closed").drop("closed").withColumn("known", F.lit(True)))
    return both


def _batch_writer(spark: SparkSession, rules: DataFrame, path: str, delay: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(STATE).parquet(f"{path}/state/batch_id={batch_id - 1}") if batch_id > 0 else None
        days = _merged(batch, before).persist()
        try:
            # The watermark of the next batch; days that end before it get no more records.
            newest = days.agg(F.max("seen")).first()[0]
            over = F.to_timestamp(F.date_add("ds", 1)) <= F.lit(newest) - F.expr(f"INTERVAL {delay}")
            series = days.where("category IS NOT NULL")
            found = breaches(variations(series).where("NOT known"), rules).withColumn("closed", F.coalesce(over, F.lit(False)))
            for name, which in (("alerts", F.col("closed")), ("open", ~F.col("closed"))):
                found.where(which).drop("closed").write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
            closed = days.withColumn("closed", F.col("known") | F.coalesce(over, F.lit(False)))
            back = F.row_number().over(Window.partitionBy("whole", "category", "closed").orderBy(F.col("ds").desc()))
            kept = closed.withColumn("_back", back).where("NOT closed OR _back = 1 AND category IS NOT NULL")
            kept.selectExpr("category", "ds", "y", "seen", "whole", "closed").write.mode("overwrite").parquet(f"{path}/state/batch_id={batch_id}")
        finally:
            days.unpersist()

    return write


def alert_stream(
    stream: DataFrame,
    rules: DataFrame,
    path: str,
    time: str,
    category: str,
    value: str,
    delay: str = "1 day",
    **trigger,
) -> StreamingQuery:
    """Start the check; alerts land below ``path``. ``trigger`` is passed on, ``availableNow=True`` by default."""
    spark = stream.sparkSession
    daily = daily_stream(stream, time, category, value, delay)
    writer = daily.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
    return writer.foreachBatch(_batch_writer(spark, rules, path, delay)).trigger(**(trigger or {"availableNow": True})).start()


def read_alerts(spark: SparkSession, path: str, open_days: bool = True) -> DataFrame:
    """Alerts ``(category, ds, variation, label)`` of all closed days, and of open days as the last batch left them."""
    out = spark.read.schema(ALERTS).parquet(f"{path}/alerts")
    if open_days:
        last = spark.read.schema(f"{STATE}, batch_id bigint").parquet(f"{path}/state").agg(F.max("batch_id")).first()[0]
        out = out.unionByName(spark.read.schema(ALERTS).parquet(f"{path}/open").where(F.col("batch_id") == last))
    return out.drop("batch_id")
