"""Mixing sources to target weights with a time-varying curriculum.

Every source has a target in words, shared out by weight and limited by how often a word may be used. Its
weight may change during training: the schedule is a piecewise linear curve over training time 0 to 1, whose
integral is the share of the target that has been used by then. A document that begins at word ``x`` of its
source's stream is therefore trained on at the time where the integral reaches ``x``; the documents in the
order of these times are the curriculum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD
from tidemark.plans.ordered import row_index, running_total

WEIGHTS = (5.0, 2.0, 1.0)
# Schedules that repeat like the weights: the first sources grow towards the end, the last ones fade.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
PLACES = 20_000  # copies in a range bucket of the training order
BUCKET_DIGITS = 3  # hexadecimal digits of the order that make a bucket


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, place, source_size, target)``: places by code point with null last, targets in words.

    ``share`` times all words are divided by weight (``weights`` repeat over the places). A target stops at
    ``most`` times its source's size and the rest is shared again. That ends at the level L with
    target = least(most * size, L * weight); with the sources in the order of size / weight, L is the largest of
    (what is left after the sources before) / (weight of this one and all after), so one ordered pass finds it.
    """
    if share > most:
        raise ValueError("the sources cannot give that many words")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = row_index(
        totals.select("source", "source_size", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name")),
        [], ["_null", "_name"], "place",
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = placed.select(
        "source", "place", "source_size", weight.alias("_weight"), (F.col("source_size") * most).alias("_cap")
    ).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    before = running_total(rows, [], ["_ratio", "place"], F.col("_cap"), "_caps")
    before = running_total(before, [], ["_ratio", "place"], F.col("_weight"), "_weights")
    whole = rows.agg((F.sum("source_size") * share).alias("_words"), F.sum("_weight").alias("_all"))
    left = F.col("_words") - (F.col("_caps") - F.col("_cap"))
    level = before.join(F.broadcast(whole)).agg(  # one row
        F.max(left / (F.col("_all") - (F.col("_weights") - F.col("_weight")))).alias("_level")
    )
    target = F.least(F.col("_cap"), F.coalesce("_level", F.lit(0.0)) * F.col("_weight"))
    return rows.join(F.broadcast(level)).select("source", "place", "source_size", target.alias("target"))


def _time(used: Column, schedules, place: Column) -> Column:
    """When a source with the schedule of its place has used the part ``used`` of its target."""
    out = None
    for n, knots in enumerate(schedules):
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        if area <= 0 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
            raise ValueError("a schedule runs from time 0 to 1 with weights that are not negative and not all zero")
        when, done = F.lit(1.0), 0.0
        steps = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            width, part = t1 - t0, (t1 - t0) * (w0 + w1) / 2
            if part > 0:
                need = F.greatest(used * area - done, F.lit(0.0))
                slope = (w1 - w0) / width
                # w0 * x + slope * x^2 / 2 = need, in a form without cancellation.
                x = 2 * need / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * need, F.lit(0.0)))) if slope or w0 == 0 else need / w0
                steps.append((used * area <= done + part, F.least(t0 + F.coalesce(x, F.lit(0.0)), F.lit(t1))))
            done += part
        for condition, value in reversed(steps):
            when = F.when(condition, value).otherwise(when)
        out = when if out is None else F.when(place % len(schedules) == n, when).otherwise(out)
    return out


def plan_mix(
    sized: DataFrame, key: list[str], weights=WEIGHTS, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES
) -> DataFrame:
    """Decide for every row of ``sized`` (columns ``source``, ``size``, ``key``, any others) what the mix takes.

    Adds ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``copies``, an array of
    ``(copy, words, position)`` with a copy per pass over the source that uses the document; position is the
    training time of its first word. A source's documents stand in the order of the md5 digest of ``key``; passes over
    them go on until the rounded target is used up, so the last document of a source may be used in part.
    Sizes are summed up in buckets of that digest first, so no task orders a whole source. A null size counts as
    0, and documents without words are not taken; a null source is a source; rows that repeat wholly are
    interchangeable and count one by one. Columns named like the new ones are replaced. An empty table gives an
    empty one.
    """
    columns = [c for c in sized.columns if c not in ("source_size", "target", "taken", "copies")]
    sized = sized.select(*[F.col(f"`{c}`") for c in columns])
    hashed = F.md5(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in key]))
    rows = sized.withColumns({
        "_size": F.coalesce("size", F.lit(0)).cast("long"), "_source": F.coalesce("source", F.lit("")),
        "_none": F.col("source").isNull(), "_hash": hashed, "_bucket": F.substring(hashed, 1, BUCKET_DIGITS),
    })
    group = ["_none", "_source", "_bucket"]
    targets = source_targets(rows.select("source", F.col("_size").alias("size")), weights, share, most).select(
        F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"),
        "place", "source_size", "target",
    )
    sums = rows.groupBy(*group).agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_none", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    offsets = offsets.join(targets, ["_none", "_source"])
    order = Window.partitionBy(*group).orderBy("_hash", *[F.col(f"`{k}`") for k in key], "_size")
    placed = rows.join(offsets, group).withColumn(
        "_start", F.col("_offset") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    )
    budget = F.round("target").cast("long")

    def copy(n: int) -> Column:
        first = F.col("_start") + F.col("source_size") * n
        words = F.greatest(F.least(budget - first, F.col("_size")), F.lit(0)).cast("long")
        used = F.coalesce(F.try_divide(first.cast("double"), F.col("target")), F.lit(0.0))
        return F.struct(F.lit(n).alias("copy"), words.alias("words"), _time(used, schedules, F.col("place")).alias("position"))

    passes = F.array(*[copy(n) for n in range(max(1, -int(-most // 1)))])
    out = placed.withColumn("copies", F.filter(passes, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return out.withColumn("taken", taken).select(*columns, "source_size", "target", "taken", "copies")


def training_order(plan: DataFrame) -> DataFrame:
    """One row per copy with ``copy``, ``words`` and ``position``, range-sorted by position."""
    rest = [c for c in plan.columns if c not in ("copies", "copy", "words", "position")]
    return plan.select(*rest, F.inline("copies")).orderBy("position")


def first_places(plan: DataFrame, key: str) -> DataFrame:
    """``(key, position, place)`` for every key the mix takes: when its first copy is trained on, and how many copies come
    before it in the training order.

    Copies with the same position stand in the order of the pass, the key and the words. Places come from range
    buckets over the positions, so no task sees the whole order. Rows that share a key have the place of their
    earliest copy; a missing key is a key.
    """
    order = row_index(
        plan.select(F.col(f"`{key}`").alias("_key"), F.inline("copies")).withColumn("_none", F.col("_key").isNull()),
        [], ["position", "copy", "_none", "_key", "words"], "place", rows_per_bucket=PLACES,
    )
    first = order.groupBy("_key").agg(F.min("position").alias("position"), F.min("place").alias("place"))
    return first.withColumnRenamed("_key", key)
