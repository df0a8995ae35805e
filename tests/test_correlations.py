"""Correlations over complete pairs against pandas, for wide tables, missing values, large means and constants."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.stats import corr_matrix, top_correlations


def matrix_of(spark, pdf, parts=5):
    df = spark.createDataFrame(pdf).repartition(parts)
    return {(r["column_a"], r["column_b"]): r["correlation"] for r in corr_matrix(df, list(pdf.columns)).collect()}


@pytest.mark.parametrize("columns, rows", [(3, 400), (200, 3000)])
def test_equals_pandas(spark, columns, rows):
    rng = np.random.default_rng(columns)
    values = rng.normal(size=(rows, columns)) + rng.normal(size=(rows, 1)) * rng.random(columns)
    # Large means and small spreads, and a third of the values missing.
    values = values * 10.0 ** rng.integers(-3, 4, columns) + 10.0 ** rng.integers(0, 7, columns)
    values[rng.random(values.shape) < 0.3] = np.nan
    pdf = pd.DataFrame(values, columns=[f"c{i}" for i in range(columns)])
    got = matrix_of(spark, pdf)
    centred = (pdf - pdf.mean()).corr()
    assert len(got) == columns * columns
    for a in pdf.columns:
        for b in pdf.columns:
            assert got[a, b] == pytest.approx(centred.loc[a, b], abs=1e-8)


def test_constants_gaps_and_endless_values(spark):
    nan = float("nan")
    pdf = pd.DataFrame({
        "x": [1e9, 1e9 + 1, 1e9 + 2, 1e9 + 3, 5.0, 6.0], "same": [0.1] * 6, "none": [nan] * 6,
        # Over the rows that it shares with "some", x has only whole numbers near 1e9.
        "some": [1.0, 2.0, 3.0, 4.0, nan, nan], "apart": [nan, nan, nan, nan, 1.0, 2.0], "once": [nan, 0.3, nan, nan, nan, nan],
        "endless": [1.0, 2.0, 3.0, 4.0, 5.0, float("inf")],
    })
    for parts in (1, 3, 6):
        got = matrix_of(spark, pdf, parts)
        assert got["x", "some"] == pytest.approx(1.0) and got["x", "x"] == 1.0
        assert all(got["same", c] is None and got["none", c] is None and got["once", c] is None for c in pdf.columns)
        assert got["some", "apart"] is None
        assert math.isnan(got["endless", "x"]) and got["endless", "some"] == pytest.approx(1.0)


def test_equal_values_where_both_are_present(spark):
    """A column that varies, but not over the rows it shares with another one."""
    nan = float("nan")
    rows = [(0.1 * 3, float(i)) for i in range(50)] + [(float(i), nan) for i in range(50)]
    got = matrix_of(spark, pd.DataFrame(rows, columns=["a", "b"]), 7)
    assert got["a", "b"] is None and got["a", "a"] == 1.0


def test_empty_table_and_order(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [r["correlation"] for r in corr_matrix(df).collect()] == [None] * 4 and top_correlations(df).count() == 0
    pdf = pd.DataFrame({"a": [1.0, 2, 3], "b": [2.0, 4, 6], "c": [3.0, 2, 1]})
    got = [(r["sign"], r["rank"], r["column_a"], r["column_b"]) for r in top_correlations(spark.createDataFrame(pdf)).orderBy("sign", "rank").collect()]
    assert got == [("negative", 1, "a", "c"), ("negative", 2, "b", "c"), ("positive", 1, "a", "b")]
