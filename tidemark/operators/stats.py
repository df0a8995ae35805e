"""Descriptive statistics, distributions, correlation, least squares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import as_double
from tidemark.operators.aggregates import with_key
from tidemark.plans.gram import pair_moments
from tidemark.plans.lookups import lookup_join
from tidemark.plans.quantiles import quantiles
from tidemark.plans.stages import steady
from tidemark.spec import numeric_columns


def describe_columns(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, std, min, quartiles and max, one row per column."""
    columns = columns or numeric_columns(df)
    df = steady(df.select(*columns), "columns")
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[f(as_double(c)).alias(f"{m}_{i}") for i, c in enumerate(columns) for m, f in measures.items()])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, c in enumerate(columns)
    ]
    long = one.select(F.inline(F.array(*rows)))
    parts = quantiles(df, columns, [0.25, 0.5, 0.75], approx=approx)
    parts = parts.select("column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    # One row per column on either side.
    return long.join(F.broadcast(parts), "column", "left")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Rows per equal-width bin between the extremes, empty bins included; the last bin is closed.

    No job runs before the result is asked for. Without values there are no bins.
    """
    values = df.select(as_double(column).alias("x")).where(F.col("x").isNotNull())
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(1.0)
    range_ = values.agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low IS NOT NULL").withColumn("width", width)
    # One row, so the joins are broadcasts.
    slot = F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counted = values.join(F.broadcast(range_)).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    edges = range_.select("low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
    )
    return edges.join(counted, "bin", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0).cast("bigint")))


def box_stats(df: DataFrame, column: str, by: str, approx: bool = False) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR, mean, deviation and outlier count per category."""
    df = steady(with_key(df.select(by, as_double(column).alias("x")), by, "x"), "box")
    quart = quantiles(df, ["x"], [0.25, 0.5, 0.75], by=[by], approx=approx).select(
        by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    fenced = quart.withColumn("_reach", 1.5 * (F.col("q3") - F.col("q1")))
    joined = lookup_join(df, fenced, [by])
    inside = F.col("x").between(F.col("q1") - F.col("_reach"), F.col("q3") + F.col("_reach"))
    return joined.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.count_if(~inside).alias("outliers"),
    )


def _pair_rows(df: DataFrame, columns: list[str], diagonal: bool = False) -> DataFrame:
    """Correlation of every pair of columns over rows that have both, from one scan for any number of columns."""
    pairs = pair_moments(df, columns)
    r = F.try_divide(F.col("cxy"), F.sqrt("cxx") * F.sqrt("cyy"))
    # Pairs without a common row have no moments but a place in the result.
    every = df.sparkSession.range(len(columns)).selectExpr("CAST(id AS INT) AS i", f"explode(sequence(CAST(id AS INT), {len(columns) - 1})) AS j")
    if not diagonal:
        every = every.where("i < j")
    names = F.array(*[F.lit(c) for c in columns])
    return every.join(pairs, ["i", "j"], "left").select(
        F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"),
        F.when(r.isNull() | F.isnan(r), r).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("correlation"),
    )


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns, both directions and the diagonal, in long form."""
    columns = columns or numeric_columns(df)
    upper = _pair_rows(df, columns, diagonal=True)
    same = F.col("column_a") == F.col("column_b")
    # A column's correlation with itself is 1 to the last bit, or missing.
    value = F.when(same & F.col("correlation").isNotNull(), 1.0).otherwise(F.col("correlation")).alias("correlation")
    there = F.struct("column_a", "column_b", value)
    back = F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), value)
    return upper.select(F.inline(F.when(same, F.array(there)).otherwise(F.array(there, back))))


def top_correlations(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` strongest positive and negative pairs; equal to 12 digits counts as a tie, settled by name."""
    columns = columns or numeric_columns(df)
    r = _pair_rows(df, columns).where(F.col("correlation").isNotNull() & (F.col("correlation") != 0))
    signed = r.withColumn("sign", F.when(F.col("correlation") > 0, "positive").otherwise("negative"))
    # One row per pair of columns reaches this window.
    order = Window.partitionBy("sign").orderBy(F.round(F.abs("correlation"), 12).desc(), "column_a", "column_b")
    return signed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ols_trend(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` with r2 and the number of pairs, overall or per group."""
    a, b = as_double(y), as_double(x)
    return with_key(df, *by).groupBy(*by).agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"),
        F.regr_count(a, b).alias("n"),
    )
