"""Format checks of contact data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted e-mail and phone formats.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^(\+212|0)[5-7][0-9]{8}$"


def valid_email(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(EMAIL_PATTERN), F.lit(False))


def valid_phone(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(PHONE_PATTERN), F.lit(False))


def validity_counts(df: DataFrame, **flags: Column) -> DataFrame:
    """``(check, valid, invalid)`` for every named flag, in one pass."""
    one = df.agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()], F.count(F.lit(1)).alias("_n"))
    rows = [
        F.struct(F.lit(n).alias("check"), F.col(n).alias("valid"), (F.col("_n") - F.col(n)).alias("invalid"))
        for n in flags
    ]
    return one.select(F.inline(F.array(*rows)))
