"""Column expressions shared by the operators; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: str | Column) -> Column:
    """The value, with NaN as missing."""
    return F.when(~F.isnan(col_of(c).cast("double")), col_of(c))


def as_double(c: str | Column) -> Column:
    """As double, with NaN as missing."""
    return F.nullif(col_of(c).cast("double"), F.lit(float("nan")))


def total(c: str | Column) -> Column:
    """Sum as double, 0 when there is nothing to add. Decimals are added exactly before the cast."""
    return F.coalesce(F.sum(present(c)).cast("double"), F.lit(0.0))


def mean(c: str | Column) -> Column:
    """Mean as double; for decimals the sum is exact, so the result does not depend on the row order."""
    return F.try_divide(F.sum(present(c)).cast("double"), F.count(present(c)).cast("double"))


def percent_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def change(current: Column, previous: Column) -> Column:
    """Relative change; NULL over a zero or missing base."""
    return F.try_divide(current - previous, previous)


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over complete pairs, NULL for a constant column.

    ``corr`` itself divides by zero on a constant column under ANSI mode.
    """
    a, b = as_double(a), as_double(b)
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def grade(value: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """Label of the first threshold that ``value`` exceeds; ``other`` when none (or NULL)."""
    label = None
    for limit, name in steps:
        label = F.when(value > limit, name) if label is None else label.when(value > limit, name)
    return label.otherwise(other)
