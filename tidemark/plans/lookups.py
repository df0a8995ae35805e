"""Joins of a long table with a table that should be small, without trusting that it is."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``; ``how`` is inner, left, left_semi or left_anti.

    One plain equi-join for every size: adaptive execution broadcasts the small side once its size is known to be
    below ``spark.sql.autoBroadcastJoinThreshold``, and otherwise splits a key with a large share of ``big`` over
    several tasks.
    """
    return big.join(small, keys, how)
