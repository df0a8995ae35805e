"""Exact quantiles with linear interpolation, in long form."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.stages import PLAIN, UNSTABLE, nature, stored

# Bins of the first pass per unit of the logarithm, and bins of the second pass within one of the first.
PER_UNIT = 512
BINS = 1 << 16
# Up to this many bins are looked up row by row in a list; of more bins all rows meet in a join.
FEW = 256


def _coarse(x: Column) -> Column:
    """A bin number that grows with x: about 0.2 % of x wide, at most 722,000 over all doubles."""
    size = F.floor(F.log1p(F.least(F.abs(x), F.lit(1e300)) * 1e6) * PER_UNIT)
    return F.when(x < 0, -size - 1).otherwise(size)


def _fine(x: Column, low: Column, high: Column) -> Column:
    """A bin number that grows with x between ``low`` and ``high``."""
    part = F.floor((x - low) / (high - low) * BINS)
    wide = F.when(x <= low, 0).when(x >= high, BINS).otherwise(1)  # for a range too wide for a double
    return F.when(high - low < float("inf"), part).otherwise(wide)


def quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = (), approx: bool = False) -> DataFrame:
    """One row per group and column: ``(*by, column, n, q0, q1, ...)`` for ``probs`` in order.

    Selection by rank, for all groups, columns and quantiles at once. The first pass counts the values of bins that
    are narrow in proportion to the value; running totals tell which bins hold the wanted ranks. The second pass counts
    within those by 65,536 bins each, and the third ranks the few values of the bins that are left. Every pass adds
    up map-side, so no group has to fit one task. Bins only steer the search: the result is exact for any values.
    Nothing runs before the result is asked for, unless the rows of ``df`` may differ from pass to pass (a sample, a
    limit); such rows are stored first. Rows that a join or an aggregate has made are shuffled once, counted by value,
    and the passes read that shuffle; plain tables are scanned by each pass. NaN is a missing value; missing values
    of ``by`` are a group.
    """
    by, group = list(by), [*by, "column"]
    df = df.select(*by, *columns)
    kind = nature(df)
    if kind == UNSTABLE and not approx:
        df = stored(df, "quantiles")
    values = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    rows = df.select(*by, F.inline(values)).where(F.col("x").isNotNull() & ~F.isnan("x"))
    # Both zeros are one value.
    rows = rows.withColumn("x", F.col("x") + 0.0)
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("column")).alias("column")
    names = [f"q{i}" for i in range(len(probs))]

    if approx:
        sketch = F.percentile_approx("x", F.array(*[F.lit(float(q)) for q in probs]), F.lit(10_000))
        out = rows.groupBy(*group).agg(F.count("x").alias("n"), sketch.alias("_q"))
        return out.select(*by, name, "n", *[F.get("_q", F.lit(i)).alias(q) for i, q in enumerate(names)])

    if kind in (PLAIN, UNSTABLE):
        rows = rows.withColumn("c", F.lit(1).cast("bigint"))
    else:
        rows = rows.groupBy(*group, "x").agg(F.count(F.lit(1)).alias("c"))

    position = {n: F.lit(float(q)) * (F.col("n") - 1) for n, q in zip(names, probs)}
    ranks = F.array_distinct(F.array(*[f(position[n]) for n in names for f in (F.floor, F.ceil)]))
    wanted = F.exists(ranks, lambda r: (F.col("first") <= r) & (r < F.col("upto")))
    settled = F.col("low") == F.col("high")
    shape = [*group, "n", "first", "upto", "low", "high"]

    def narrowed(bins: DataFrame, within: list[str], order: str) -> DataFrame:
        """Bins that hold a wanted rank, with the ranks they begin and end at."""
        ahead = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return bins.withColumn("upto", F.col("base") + F.sum("c").over(ahead)).withColumn("first", F.col("upto") - F.col("c")).where(wanted)

    def inside(bins: DataFrame, keys: list[str], *more: Column) -> DataFrame:
        """The rows of the given bins."""
        near = rows.withColumn("d1", _coarse(F.col("x")))
        if by:
            # If the bins are few, all other rows are left out before the join's shuffle.
            sign = F.xxhash64(F.lit(0), *keys)
            known = bins.select(sign.alias("h")).distinct().limit(FEW + 1).agg(F.collect_set("h").alias("h")).scalar()
            near = near.where((F.size(known) > FEW) | F.array_contains(known, sign))
        small = bins.withColumnsRenamed({k: f"_{k}" for k in keys}).drop("c")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        # Without groups there are two bins at most for each column and quantile.
        return near.join(small if by else F.broadcast(small), reduce(and_, [*same, *more])).drop(*[f"_{k}" for k in keys])

    counts = [F.sum("c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high")]
    one = rows.groupBy(*group, _coarse(F.col("x")).alias("d1")).agg(*counts).withColumn("base", F.lit(0).cast("bigint"))
    one = one.withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    one = narrowed(one, group, "d1")

    open_one = one.where(~settled).select(*group, "d1", "n", F.col("first").alias("base"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    keys = [*group, "d1"]
    two = inside(open_one, keys).withColumn("d2", _fine(F.col("x"), F.col("l1"), F.col("h1")))
    two = narrowed(two.groupBy(*keys, "n", "base", "d2").agg(*counts), keys, "d2")

    open_two = two.where(~settled).select(*keys, "n", F.col("first").alias("base"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    three = inside(open_two, keys, F.col("x").between(F.col("l2"), F.col("h2")))
    three = three.groupBy(*keys, "n", "base", "l2", "x").agg(F.sum("c").alias("c"))
    three = narrowed(three.withColumn("low", F.col("x")).withColumn("high", F.col("x")), [*keys, "l2"], "x")

    near = one.where(settled).select(*shape).unionByName(two.where(settled).select(*shape)).unionByName(three.select(*shape))

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("upto")), F.col("low")))

    ends = near.groupBy(*group, "n").agg(
        *[value(F.floor(position[n])).alias(f"{n}_lo") for n in names], *[value(F.ceil(position[n])).alias(f"{n}_hi") for n in names]
    )

    def between(n: str) -> Column:
        low, high = F.col(f"{n}_lo"), F.col(f"{n}_hi")
        return F.when(low == high, low).otherwise(low + (high - low) * (position[n] - F.floor(position[n])))

    return ends.select(*by, name, "n", *[between(n).alias(n) for n in names])
