"""Pairwise moments of many columns in one scan, by matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import as_double

# Spread below this share of the squares it comes from is rounding: the values are all equal.
ROUNDING = 1e-12


class Moments:
    """Sums over the complete rows of every pair of columns, with each column moved near zero."""

    def __init__(self, columns: int):
        self.shift = np.full(columns, np.nan)
        self.n, self.x, self.xx, self.xy, self.odd = (np.zeros((columns, columns)) for _ in range(5))

    def add(self, values: np.ndarray) -> None:
        """Rows of doubles; NaN is missing."""
        there = ~np.isnan(values)
        fresh = np.isnan(self.shift) & there.any(0)
        for c in np.flatnonzero(fresh):
            # A value of the column, so that columns with one value become zero.
            some = np.sort(values[there[:, c], c])
            self.shift[c] = some[len(some) // 2] if np.isfinite(some[len(some) // 2]) else 0.0
        endless = np.isinf(values)
        moved = np.where(there & ~endless, values - np.nan_to_num(self.shift), 0.0)
        mask = there.astype(float)
        self.n += mask.T @ mask
        self.x += moved.T @ mask
        self.xx += (moved * moved).T @ mask
        self.xy += moved.T @ moved
        if endless.any():
            self.odd += endless.T.astype(float) @ mask

    def told(self) -> pa.RecordBatch:
        """One row per pair ``i <= j`` with complete rows: count, means, sums of squared and joint deviations."""
        i, j = np.triu_indices(len(self.shift))
        keep = self.n[i, j] > 0
        i, j = i[keep], j[keep]
        n, x, y = self.n[i, j], self.x[i, j], self.x[j, i]
        spread = []
        for squares, s in ((self.xx[i, j], x), (self.xx[j, i], y)):
            rest = squares - s * s / n
            spread.append(np.where(rest <= ROUNDING * squares, 0.0, rest))
        both = self.xy[i, j] - x * y / n
        both[(self.odd[i, j] > 0) | (self.odd[j, i] > 0)] = np.nan
        shift = np.nan_to_num(self.shift)
        columns = [i, j, n, shift[i] + x / n, shift[j] + y / n, *spread, both]
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"])


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, j, n, cxx, cyy, cxy)`` for every pair ``i <= j`` of columns with complete rows.

    ``cxx`` and ``cyy`` are sums of squared deviations from the mean over rows in which both are present, 0 where all
    values are equal; ``cxy`` is the sum of their products, NaN if an infinite value is among them. Each task
    adds up its rows and sends one row per pair; these are merged by their means, so nothing is lost to large
    means. Work per row is a product of small matrices for any number of columns.
    """
    many = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = Moments(many)
        for batch in batches:
            if batch.num_rows:
                moments.add(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1))
        yield moments.told()

    values = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = values.mapInArrow(run, "i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double")
    pair = Window.partitionBy("i", "j")
    moved = parts
    for m in ("mx", "my"):
        # Means from the smallest one on: equal means stay equal.
        low = F.min(m).over(pair)
        moved = moved.withColumn(f"{m}_off", F.col(m) - low).withColumn(
            f"{m}_off", F.col(f"{m}_off") - F.sum(F.col("n") * F.col(f"{m}_off")).over(pair) / F.sum("n").over(pair)
        )
    between = lambda a, b: F.col("n") * F.col(f"{a}_off") * F.col(f"{b}_off")
    merged = moved.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("cxx") + between("mx", "mx")).alias("cxx"), F.sum(F.col("cyy") + between("my", "my")).alias("cyy"),
        F.sum(F.col("cxy") + between("mx", "my")).alias("cxy"), F.max(F.abs("mx")).alias("ax"), F.max(F.abs("my")).alias("ay"),
    )
    real = lambda c, a: F.when(F.col(c) > F.col("n") * F.pow(F.col(a) * ROUNDING / 10, F.lit(2.0)), F.col(c)).otherwise(0.0).alias(c)
    return merged.select("i", "j", "n", real("cxx", "ax"), real("cyy", "ay"), "cxy")
