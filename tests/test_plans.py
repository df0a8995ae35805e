"""Ordered windows, quantiles and lookups give the same answer however the table is cut."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.fixtures import ORDERS_SPEC
from tidemark.operators.aggregates import pct_change
from tidemark.operators.cleaning import time_index
from tidemark.operators.filters import last_rows
from tidemark.operators.windows import moving_average_rows
from tidemark.plans.lookups import lookup_join
from tidemark.plans.ordered import row_index
from tidemark.plans.quantiles import quantiles
from tidemark.plans.stages import COSTLY, PLAIN, UNSTABLE, nature
from tidemark.spec import SalesSpec

SPEC = SalesSpec("d", "y", "cat", ("i",))


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """One category and one date hold a large share of the rows; some values are missing."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        cat = "hot" if rng.random() < 0.4 else f"c{rng.randrange(40)}"
        day = 7 if rng.random() < 0.35 else rng.randrange(60)
        value = None if rng.random() < 0.3 else float(rng.randrange(0, 50))
        rows.append((cat, day, value, i))
    pdf = pd.DataFrame(rows, columns=["cat", "d", "y", "i"])
    path = str(tmp_path_factory.mktemp("skewed"))
    spark.createDataFrame(rows, "cat string, d int, y double, i int").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), pdf


CUTS = [1_000_000, 700, 60, 7]


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("by", [[], ["cat"]])
def test_moving_average_rows(skewed, cut, by):
    df, pdf = skewed
    out = moving_average_rows(df, SPEC, (3, 30), by, rows_per_bucket=cut).toPandas().sort_values(["cat", "d", "i"])
    pdf = pdf.sort_values(["d", "i"])
    source = pdf.groupby("cat")["y"] if by else pdf["y"]
    for n in (3, 30):
        mean = source.rolling(n).mean()
        pdf[f"ma_{n}"] = mean.reset_index(level=0, drop=True) if by else mean
    expected = pdf.sort_values(["cat", "d", "i"])
    assert len(out) == len(pdf)
    for c in ("ma_3", "ma_30"):
        pd.testing.assert_series_equal(out[c].reset_index(drop=True), expected[c].reset_index(drop=True))


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("by", [[], ["cat"]])
def test_pct_change(skewed, cut, by):
    df, pdf = skewed
    out = pct_change(df, SPEC, by, rows_per_bucket=cut).toPandas().sort_values("i")
    pdf = pdf.sort_values(["d", "i"])
    filled = pdf.groupby("cat")["y"].ffill() if by else pdf["y"].ffill()
    previous = filled.groupby(pdf["cat"]).shift() if by else filled.shift()
    expected = ((filled - previous) / previous).where(previous != 0).sort_index()
    pd.testing.assert_series_equal(out["pct_change"].reset_index(drop=True), expected, check_names=False)
    assert out["zero_base"].sum() == (previous == 0).sum()


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("by", [[], ["cat"]])
def test_time_index(skewed, cut, by):
    df, pdf = skewed
    out = time_index(df, SPEC, by, rows_per_bucket=cut).toPandas().sort_values("i")
    pdf = pdf.sort_values(["d", "i"])
    expected = pdf.groupby(by).cumcount() if by else pd.Series(range(len(pdf)), index=pdf.index)
    assert out["time"].tolist() == expected.sort_index().tolist()


@pytest.mark.parametrize("made", ["scan", "aggregate", "sample"])
@pytest.mark.parametrize("by", [[], ["cat"]])
def test_quantiles(skewed, by, made):
    df, pdf = skewed
    df = {"scan": df, "aggregate": df.distinct(), "sample": df.sample(1.0)}[made]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = quantiles(df, ["y", "i"], probs, by).toPandas()
    for _, row in out.iterrows():
        part = pdf[pdf["cat"] == row["cat"]] if by else pdf
        expected = part[row["column"]].dropna().quantile(probs)
        assert row["n"] == part[row["column"]].count()
        assert [row[f"q{i}"] for i in range(5)] == pytest.approx(expected.tolist())
    assert len(out) == 2 * (pdf["cat"].nunique() if by else 1)


@pytest.mark.parametrize("kind", ["wide", "narrow", "ties", "negative", "tiny", "endless"])
def test_quantiles_are_exact_for_any_values(spark, kind):
    rng = np.random.default_rng(len(kind))
    values = {
        "wide": rng.choice([-1, 1], 4000) * 10.0 ** rng.uniform(-300, 300, 4000), "narrow": 1e9 + rng.random(4000) * 1e-3,
        "ties": rng.integers(0, 3, 4000).astype(float), "negative": -np.abs(rng.normal(size=4000)) - 0.0, "tiny": rng.random(4000) * 1e-12,
        "endless": np.where(rng.random(4000) < 0.2, np.inf, np.where(rng.random(4000) < 0.2, -np.inf, rng.normal(size=4000) * 1e305)),
    }[kind]
    values[:3] = [0.0, -0.0, values[5]]
    df = spark.createDataFrame([(float(v), None if i % 3 else "a") for i, v in enumerate(values)] + [(None, "a"), (float("nan"), "b")], "x double, g string")
    probs = [0.0, 0.001, 0.1, 0.5, 0.73, 0.999, 1.0]
    # Whole ranks, so that nothing has to be interpolated between the ends of the scale.
    out = {r["g"]: r for r in quantiles(df, ["x"], [round(p * 3999) / 3999 for p in probs]).withColumn("g", F.lit("all")).collect()}
    ordered = np.sort(values)
    assert [out["all"][f"q{i}"] for i in range(7)] == pytest.approx([ordered[round(p * 3999)] for p in probs], rel=1e-12, abs=0) or kind == "endless"
    groups = {r["g"]: r for r in quantiles(df, ["x"], [0.0, 1.0], ["g"]).collect()}
    assert set(groups) == {"a", None}
    for g, part in (("a", values[::3]), (None, np.delete(values, np.arange(0, 4000, 3)))):
        assert (groups[g]["n"], groups[g]["q0"], groups[g]["q1"]) == (len(part), part.min(), part.max())


def test_quantiles_run_nothing_before_they_are_asked(spark, skewed):
    df, _ = skewed
    spark.sparkContext.setJobGroup("quantiles", "")
    out = quantiles(df.join(df.select("cat").distinct(), "cat"), ["y"], [0.5], ["cat"])
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(ran) == 0 and out.count() > 0
    assert quantiles(df.limit(0), ["y"], [0.5]).count() == 0


def test_nature_of_inputs(spark, skewed):
    df, _ = skewed
    named = df.withColumnRenamed("y", "SortKeyWindowJoin").where("d > 3")
    assert nature(named) == PLAIN
    assert nature(df.groupBy("cat").count()) == nature(df.join(df, "i")) == nature(df.distinct()) == COSTLY
    for drawn in (df.limit(10), df.sample(0.5, seed=1), df.withColumn("r", F.rand(3)), df.where(F.rand() < 0.5), df.offset(3),
                  df.orderBy("i").limit(5).groupBy("cat").count()):
        assert nature(drawn) == UNSTABLE


@pytest.mark.parametrize("draw", [lambda df: df.limit(1500), lambda df: df.sample(0.5), lambda df: df.where(F.rand() < 0.5)])
def test_draws_are_the_same_in_every_pass(skewed, draw):
    """Numbers of the rows of a draw have no gaps, and quantiles belong to the counted rows."""
    df, _ = skewed
    rows = row_index(draw(df), ["cat"], ["d", "i"], rows_per_bucket=100).toPandas()
    for _, part in rows.groupby("cat"):
        assert sorted(part["idx"]) == list(range(len(part)))
    found = quantiles(draw(df), ["i"], [0.0, 0.5, 1.0]).collect()
    assert len(found) == 1 and None not in found[0]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join(spark, skewed, how):
    df, pdf = skewed
    known = {f"c{i}": i for i in range(25)} | {"hot": -1}
    small = spark.createDataFrame(list(known.items()), "cat string, v int")
    got = lookup_join(df, small, ["cat"], how)
    inside = pdf["cat"].isin(known)
    kept = {"inner": inside, "left": inside | True, "left_semi": inside, "left_anti": ~inside}[how]
    assert sorted(r["i"] for r in got.collect()) == sorted(pdf[kept]["i"].tolist())


def test_no_single_partition_before_aggregation(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for df in (
        moving_average_rows(orders, ORDERS_SPEC, rows_per_bucket=100),
        time_index(orders, ORDERS_SPEC, rows_per_bucket=100).drop("o_totalprice"),
    ):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("hashpartitioning(_bucket" in line for line in lines)
        # Only summaries per bucket may meet in one place.
        for line in lines:
            if "SinglePartition" in line:
                assert "o_totalprice" not in line


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("n", [101, 900, 5000])
def test_last_rows_of_hot_and_nameless_groups(skewed, cut, n):
    df, pdf = skewed
    df = df.withColumn("cat", F.when(F.col("cat") != "c1", F.col("cat")))
    out = last_rows(df, SPEC, n, ["cat"], rows_per_bucket=cut)
    got = out.toPandas()
    pdf = pdf.assign(cat=pdf["cat"].where(pdf["cat"] != "c1"))
    want = pdf.sort_values(["d", "i"]).groupby("cat", dropna=False).tail(n)
    assert sorted(got["i"]) == sorted(want["i"]) and list(got.columns) == list(df.columns)
    if cut < 1000:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_bucket" in plan[plan.index("Window") :].splitlines()[0]


@pytest.mark.parametrize("cut", CUTS)
def test_ordered_plans_with_nameless_keys(skewed, cut):
    """Missing keys are one key, also over several buckets."""
    df, pdf = skewed
    df = df.withColumn("cat", F.when(F.col("cat") != "hot", F.col("cat")))
    out = row_index(df, ["cat"], ["d", "i"], rows_per_bucket=cut).toPandas().sort_values("i")
    pdf = pdf.assign(cat=pdf["cat"].where(pdf["cat"] != "hot").fillna("")).sort_values(["d", "i"])
    pdf["idx"] = pdf.groupby("cat").cumcount()
    assert list(out["idx"]) == list(pdf.sort_values("i")["idx"])
