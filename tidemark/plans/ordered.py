"""Ordered computations over whole tables without a single-partition sort.

``Window.orderBy`` without ``partitionBy`` sends every row to one task, and ``partitionBy(category)``
sends a hot category to one task. Here the rows are cut into *range buckets* over ``(keys, order)``:

* bounds come from a bounded sample and only steer the balance, never the result;
* the bucket number is a codegen'd binary search over literal bounds, so assigning it moves no data;
* what a bucket needs from earlier buckets (a running offset, the last value, the last H rows) is
  aggregated map-side and has at most two rows per bucket and carried row, so it is safe to broadcast;
* an input that is more than a filtered scan is written to the shared folder first, since it is read
  several times;
* one shuffle by ``(bucket, keys)`` then runs an ordinary window per bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.stages import reusable

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 8192
SAMPLE_PER_BUCKET = 16
BUCKET = "_bucket"


@dataclass(frozen=True)
class Bucketed:
    """Rows with a bucket number; ``spanning`` has the keys that occur in more than one bucket."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    count: int
    spanning: DataFrame | None

    @property
    def single(self) -> bool:
        return self.count == 1

    @property
    def group(self) -> list[str]:
        return [BUCKET, *self.keys]

    def window(self, descending: bool = False):
        order = [F.col(c).desc() for c in self.order] if descending else self.order
        if self.single and not self.keys:
            # One bucket holds at most ROWS_PER_BUCKET rows, which one task may sort.
            return Window.partitionBy(F.lit(0)).orderBy(*order)
        return Window.partitionBy(*self.group).orderBy(*order)

    def spanning_rows(self) -> DataFrame:
        """Rows of keys that continue in another bucket (all rows when there are no keys)."""
        if not self.keys:
            return self.df
        return _join_nulls(self.df, self.spanning, self.keys, "left_semi")

    def join_small(self, big: DataFrame, small: DataFrame) -> DataFrame:
        """Left join with a per-(bucket, spanning key) table: at most 2 x MAX_BUCKETS rows, so broadcast."""
        return _join_nulls(big, small, self.group, "left")


def _join_nulls(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Broadcast join in which missing keys are equal."""
    renamed = small.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)})
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    joined = big.join(F.broadcast(renamed), reduce(and_, same), how)
    return joined if how == "left_semi" else joined.drop(*[f"_k{i}" for i in range(len(keys))])


def _bounds(keys: DataFrame, buckets: int, total: int) -> list[str]:
    """At most ``buckets - 1`` cut points as JSON, from a sample whose size depends on ``buckets`` only."""
    wanted = buckets * SAMPLE_PER_BUCKET
    sample = keys if wanted * 2 >= total else keys.sample(fraction=min(1.0, 1.2 * wanted / total), seed=11)
    rows = sample.select(*keys.columns, F.to_json(F.struct(*keys.columns)).alias("_json")).orderBy(*keys.columns)
    picks = [r["_json"] for r in rows.select("_json").collect()]
    cuts = [picks[i * len(picks) // buckets] for i in range(1, buckets)] if picks else []
    return list(dict.fromkeys(cuts))


def bucketize(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> Bucketed:
    """Attach range buckets over ``(keys, order)``; counts the rows once to choose how many."""
    df = reusable(df, "ordered")
    key_columns = df.select(*keys, *order)
    total = key_columns.count()
    buckets = min(MAX_BUCKETS, math.ceil(total / rows_per_bucket))
    cuts = _bounds(key_columns, buckets, total) if buckets > 1 else []
    if not cuts:
        return Bucketed(df.withColumn(BUCKET, F.lit(0)), keys, order, 1, None)

    kind = T.ArrayType(key_columns.schema)
    here = F.struct(*[F.col(c) for c in [*keys, *order]])
    bits = len(cuts).bit_length()
    out = df.withColumn(BUCKET, F.lit(0))
    for bit in reversed(range(bits)):
        step = 1 << bit
        # Bounds probed at this level of the search: each bound belongs to one level only.
        level = F.from_json(F.lit("[" + ",".join(cuts[step - 1 :: 2 * step]) + "]"), kind)
        probe = F.get(level, F.shiftright(BUCKET, bit + 1))
        out = out.withColumn(BUCKET, F.when(here >= probe, F.col(BUCKET) + step).otherwise(F.col(BUCKET)))

    spanning = None
    if keys:
        parsed = F.from_json(F.lit("[" + ",".join(cuts) + "]"), kind)
        spanning = df.sparkSession.range(1).select(F.inline(parsed)).select(*keys).distinct()
    return Bucketed(out, keys, order, len(cuts) + 1, spanning)


def _earlier_buckets(b: Bucketed):
    by = b.keys or [F.lit(0)]
    return Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def running_total(
    df: DataFrame, keys: list[str], order: list[str], amount: Column, into: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add the sum of ``amount`` over this row and all earlier rows of its key."""
    b = bucketize(df.withColumn("_amount", amount), keys, order, rows_per_bucket)
    local = F.sum("_amount").over(b.window().rowsBetween(Window.unboundedPreceding, 0))
    out = b.df.withColumn(into, local)
    if not b.single:
        sums = b.spanning_rows().groupBy(*b.group).agg(F.sum("_amount").alias("_sum"))
        offset = sums.select(*b.group, F.sum("_sum").over(_earlier_buckets(b)).alias("_offset"))
        out = b.join_small(out, offset).withColumn(into, F.col(into) + F.coalesce("_offset", F.lit(0)))
    return out.select(*df.columns, into)


def row_index(df: DataFrame, keys: list[str], order: list[str], into: str = "idx", **kw) -> DataFrame:
    """Running number 0, 1, 2 ... of every row within its key."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), into, **kw).withColumn(into, F.col(into) - 1)


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: Column, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``_filled`` (the value, or the last one before it) and ``_previous`` (``_filled`` of the row before)."""
    b = bucketize(df.withColumn("_value", value), keys, order, rows_per_bucket)
    w = b.window()
    filled = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = b.df.withColumn("_filled", filled).withColumn("_previous", F.lag("_filled").over(w))
    if not b.single:
        position = F.when(F.col("_value").isNotNull(), F.struct(*order))
        last = b.spanning_rows().groupBy(*b.group).agg(F.max_by("_value", position).alias("_last"))
        carry = last.select(*b.group, F.last("_last", ignorenulls=True).over(_earlier_buckets(b)).alias("_carry"))
        out = b.join_small(out, carry).withColumns(
            {"_filled": F.coalesce("_filled", "_carry"), "_previous": F.coalesce("_previous", "_carry")}
        )
    return out.select(*df.columns, "_filled", "_previous")


def last_of_keys(df: DataFrame, keys: list[str], order: list[str], n: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The last ``n`` rows of every key.

    Counts per key and bucket tell how many rows follow a bucket: buckets that ``n`` or more rows follow are left out
    before any shuffle, and the others are ranked each by itself.
    """
    b = bucketize(df, keys, order, rows_per_bucket)
    out, room = b.df, F.lit(n)
    if not b.single:
        sizes = b.spanning_rows().groupBy(*b.group).agg(F.count(F.lit(1)).alias("_size"))
        by = b.keys or [F.lit(0)]
        later = F.sum("_size").over(Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing))
        rooms = sizes.select(*b.group, (F.lit(n) - F.coalesce(later, F.lit(0))).alias("_room"))
        out = b.join_small(out, rooms).where(F.coalesce("_room", F.lit(n)) > 0)
        room = F.coalesce("_room", F.lit(n))
    back = F.row_number().over(b.window(descending=True))
    return out.withColumn("_back", back).where(F.col("_back") <= room).select(*df.columns)


def _halo(b: Bucketed, rows: int) -> DataFrame:
    """Copies of the last rows before each bucket, labelled with the bucket that reads them."""
    back = F.row_number().over(b.window(descending=True))
    tail = b.spanning_rows().withColumn("_back", back).where(F.col("_back") <= rows)
    size = F.least(F.count(F.lit(1)), F.lit(rows).cast("bigint"))
    sizes = b.spanning_rows().groupBy(*b.group).agg(size.alias("_size"))
    by = b.keys or [F.lit(0)]
    ahead = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(1, rows)
    # A later bucket reads this row when the candidates in between leave room for it.
    following = F.collect_list(F.struct(F.col(BUCKET).alias("to"), F.col("_size").alias("size"))).over(ahead)
    between = F.transform(
        "_next",
        lambda x, i: F.struct(
            x["to"].alias("to"),
            F.aggregate(
                F.slice("_next", F.lit(1), i), F.lit(0).cast("bigint"), lambda acc, y: acc + y["size"]
            ).alias("skip"),
        ),
    )
    readers = sizes.withColumn("_next", following).select(*b.group, F.inline(between))
    copies = _join_nulls(tail, readers.where(F.col("skip") < rows), b.group, "inner")
    return copies.where(F.col("_back") + F.col("skip") <= rows).withColumn(BUCKET, F.col("to")).drop("_back", "to", "skip")


def rolling(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    build,
    width: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add columns over frames of at most ``width`` rows ending at the current one.

    ``build(window)`` returns ``{name: Column}`` for an ordered window without frame.
    """
    b = bucketize(df, keys, order, rows_per_bucket)
    if b.single:
        return b.df.withColumns(build(b.window())).drop(BUCKET)
    rows = b.df.withColumn("_copy", F.lit(False))
    copies = _halo(b, width - 1).withColumn("_copy", F.lit(True))
    out = rows.unionByName(copies).withColumns(build(b.window()))
    return out.where(~F.col("_copy")).drop("_copy", BUCKET)
