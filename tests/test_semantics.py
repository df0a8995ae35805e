"""Small tables for the rules on nulls, order, dates, gaps and ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.forecasting.series import prepare_series, rejected_series
from tidemark.functions.dates import parse_dates
from tidemark.functions.validation import valid_email, valid_phone
from tidemark.operators import aggregates, alerts, cleaning, filters, profiles, stats, windows
from tidemark.sources.sinks import append_rows, export, read_appended
from tidemark.sources.tables import load_table
from tidemark.spec import SalesSpec, check_table, detect_roles

SPEC = SalesSpec("d", "y", "cat", ("i",))


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def sales(spark, rows):
    """Rows of (category, day number, value); the tie-breaker is the position."""
    data = [(c, day(d), y, i) for i, (c, d, y) in enumerate(rows)]
    return spark.createDataFrame(data, "cat string, d date, y double, i int")


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_null_keys_form_no_group(spark):
    df = sales(spark, [("a", 1, 1.0), (None, 1, 2.0)])
    assert values(aggregates.category_performance(df, SPEC), "cat", "total") == [("a", 1.0)]
    assert values(filters.distinct_values(df, "cat"), "cat") == [("a",)]


def test_sum_of_nothing_is_zero(spark):
    df = sales(spark, [("a", 1, None)])
    assert values(aggregates.kpi_summary(df, SPEC), "total", "mean") == [(0.0, None)]


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 1])
def test_growth_fills_nulls_and_skips_zero_base(spark, rows_per_bucket):
    df = sales(spark, [("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, None), ("a", 4, 10.0)])
    out = aggregates.growth_mean(df, SPEC, rows_per_bucket=rows_per_bucket)
    assert values(out, "growth", "n_zero_base") == [(50.0, 1)]


def test_moving_average_strict_and_partial(spark):
    df = sales(spark, [("a", n, float(n)) for n in range(1, 6)])
    assert {r[0] for r in values(windows.moving_average(df, SPEC, (7,)), "ma_7")} == {None}
    partial = sorted(values(windows.moving_average_partial(df, SPEC, (7,)), "date", "ma_7"))
    assert [r[1] for r in partial] == [1.0, 1.5, 2.0, 2.5, 3.0]


def test_null_in_window_gives_null(spark):
    df = sales(spark, [("a", n, None if n == 3 else 1.0) for n in range(1, 8)])
    out = sorted(values(windows.moving_average_rows(df, SPEC, (3,)), "d", "ma_3"))
    assert [r[1] for r in out] == [None, None, None, None, None, 1.0, 1.0]


def test_equal_dates_are_added_up(spark):
    df = sales(spark, [("a", 1, 1.0), ("a", 1, 2.0), ("a", 1, 3.0)])
    assert values(aggregates.daily_totals(df, SPEC), "date", "value") == [(day(1), 6.0)]


@pytest.mark.parametrize("fill, expected", [("ffill", [1.0, 2.0, 2.0, 2.0, 5.0]), ("zero", [1.0, 2.0, 0.0, 0.0, 5.0])])
def test_gaps(spark, fill, expected):
    df = sales(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("a", 5, 5.0)])
    out = prepare_series(df, SPEC, ["cat"], min_points=1, fill=fill).orderBy("ds")
    assert values(out, "ds", "y") == [(day(n), v) for n, v in enumerate(expected, 1)]


def test_short_series_are_rejected_and_others_kept(spark):
    df = sales(spark, [("long", n, 1.0) for n in range(1, 15)] + [("short", n, 1.0) for n in range(1, 14)])
    assert {r[0] for r in values(prepare_series(df, SPEC, ["cat"]), "series_key")} == {"long"}
    assert values(rejected_series(df, SPEC, ["cat"]), "series_key", "n") == [("short", 13)]


def test_positional_series(spark):
    df = sales(spark, [("a", 9, 1.0), ("a", 9, 2.0), ("a", 20, 3.0)])
    out = prepare_series(df, SPEC, min_points=1, mode="positional").orderBy("ds")
    assert values(out, "ds", "y") == [(day(1), 1.0), (day(2), 2.0), (day(3), 3.0)]


def test_weeks_end_on_sunday_and_have_no_holes(spark):
    df = sales(spark, [("a", n, float(n)) for n in (1, 7, 8, 22)]).withColumn("promo", F.lit("Oui"))
    out = aggregates.promo_weekly(df, SalesSpec("d", "y", promo_col="promo")).orderBy("week")
    assert values(out, "week", "mean_with") == [(day(7), 4.0), (day(14), 8.0), (day(21), None), (day(28), 22.0)]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    out = {(r["column_a"], r["column_b"]): r["correlation"] for r in stats.corr_matrix(df).collect()}
    assert out == {("a", "b"): None, ("b", "a"): None, ("a", "a"): None, ("b", "b"): 1.0}


def test_dates_as_text(spark):
    texts = ["2024-01-02", "03/04/2024", "3.4.2024 10:30", "45292", "abc", None, "2024-02-30"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    out = [r["d"] for r in parse_dates(df, "d").orderBy("i").collect()]
    assert out == [dt.datetime(2024, 1, 2), dt.datetime(2024, 4, 3), dt.datetime(2024, 4, 3, 10, 30), None, None, None, None]


def test_dates_as_serial_numbers(spark):
    df = spark.createDataFrame([(45292.0,), (45292.75,), (None,)], "d double")
    out = [r["d"] for r in parse_dates(df, "d").collect()]
    assert out == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 18), None]
    with pytest.raises(ValueError):
        parse_dates(spark.createDataFrame([(5.0,), (7.0,)], "d double"), "d")


def test_last_day_counts_to_its_end(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 15), 1.0), (dt.datetime(2024, 2, 1), 2.0)], "d timestamp_ntz, y double")
    assert values(filters.filter_sales(df, SalesSpec("d", "y"), end="2024-01-31"), "y") == [(1.0,)]


def test_period_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    sales(spark, [("a", 1, 1.0)]).write.parquet(path)
    df = filters.filter_sales(spark.read.parquet(path), SPEC, "2024-01-01", "2024-01-31")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,2024-01-01)" in plan and "LessThan(d,2024-02-01)" in plan


def test_ties_and_nulls_in_top_rows(spark):
    df = sales(spark, [("a", 1, 2.0), ("b", 1, None), ("c", 1, 2.0), ("d", 1, 3.0)])
    assert values(filters.top_rows(df, "y", 4, ["i"]), "cat") == [("d",), ("a",), ("c",), ("b",)]
    ranked = aggregates.top_bottom_categories(df, SPEC, 1).collect()
    assert {(r["side"], r["cat"]) for r in ranked} == {("top", "d"), ("bottom", "b")}


def test_first_values_by_appearance(spark):
    df = sales(spark, [("z", 1, 1.0), ("a", 2, 1.0), ("z", 3, 1.0), ("m", 2, 1.0)])
    assert values(filters.first_values(df, SPEC, "cat", 2).orderBy("position"), "cat") == [("z",), ("a",)]


def test_month_ties_take_the_earlier(spark):
    df = sales(spark, [("a", 1, 5.0), ("a", 32, 5.0)])
    out = {r["period"]: r for r in profiles.season_extremes(df, SPEC).collect()}
    assert (out["month"]["best"], out["month"]["worst"], out["month"]["gap"]) == (1, 1, 0.0)


def test_promo_lift_needs_a_positive_base(spark):
    rows = [("a", "Oui", 3.0), ("a", "Non", 2.0), ("b", "Oui", 1.0), ("c", "Oui", 1.0), ("c", "Non", 0.0)]
    df = spark.createDataFrame(rows, "cat string, promo string, y double")
    spec = SalesSpec("d", "y", "cat", promo_col="promo")
    out = {r["cat"]: (r["lift"], r["verdict"]) for r in aggregates.promo_lift(df, spec, ["cat"]).collect()}
    assert out == {"a": (50.0, "very effective"), "b": (None, "not computable"), "c": (None, "not computable")}


def test_one_hot_drops_the_first_and_refuses_many(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert values(cleaning.one_hot(df, ["c"]), "c_b") == [(True,), (False,), (False,)]
    with pytest.raises(ValueError):
        cleaning.one_hot(df, ["c"], max_values=1)


def test_sparse_dummies_of_many_values(spark):
    """As many values as one likes, numbered in order; NULL and the first value have no place."""
    df = spark.range(100_000).selectExpr("id AS k", "(id * 7) % 100000 AS a", "IF(id % 3 = 0, NULL, CAST(id % 3 AS STRING)) AS b")
    out = cleaning.one_hot_sparse(df, ["a", "b"], rows_per_bucket=9000)
    assert out.columns == ["k", "a_index", "b_index", "features"]
    got = {r["k"]: (r["a_index"], r["b_index"], r["features"]["size"], r["features"]["positions"]) for r in out.where("k < 5").collect()}
    assert got == {0: (0, None, 100_000, []), 1: (7, 0, 100_000, [6]), 2: (14, 1, 100_000, [13, 99_999]), 3: (21, None, 100_000, [20]),
                   4: (28, 0, 100_000, [27])}
    assert out.count() == 100_000 and out.agg(F.count_distinct("a_index")).first()[0] == 100_000
    all_ = cleaning.one_hot_sparse(df.where("k < 2"), ["b"], drop_first=False).orderBy("k").collect()
    assert [r["features"]["positions"] for r in all_] == [[], [0]]
    assert cleaning.one_hot_sparse(df.limit(0), ["a", "b"]).count() == 0


def test_contact_formats(spark):
    df = spark.createDataFrame([("a.b@c.ma", "+212612345678"), ("a@b", "0412345678"), (None, "0712345678")], "e string, p string")
    assert values(df.select(valid_email("e").alias("e"), valid_phone("p").alias("p")), "e", "p") == [
        (True, True), (False, False), (False, True)]


def test_alerts(spark):
    series = spark.createDataFrame(
        [("a", day(1), 100.0), ("a", day(2), 120.0), ("a", day(3), 119.0), ("b", day(1), 1.0)], "category string, ds date, y double")
    rules = spark.createDataFrame([("a", 10.0, 0.5), ("a", 30.0, 5.0), ("b", 10.0, 10.0), ("x", 1.0, 1.0)], "category string, up double, down double")
    out = {(r["category"], r["up"]): r["alert"] for r in alerts.alert_check(series, rules).collect()}
    assert out == {("a", 10.0): "down", ("a", 30.0): "none", ("b", 10.0): "not enough data", ("x", 1.0): "not enough data"}
    history = sorted(values(alerts.alert_history(series, rules), "ds", "label"))
    assert history == [(day(2), "strong rise"), (day(3), "slight fall")]


def test_text_files(spark, tmp_path):
    file = tmp_path / "ventes.csv"
    file.write_bytes(" Date ;Produit;Ventes\n03/04/2024;Café;1,5\n05/04/2024;Thé;2,5\n".encode("latin-1"))
    df = load_table(spark, str(file))
    assert df.columns == ["Date", "Produit", "Ventes"]
    assert [r["Produit"] for r in df.collect()] == ["Café", "Thé"]
    (tmp_path / "one.csv").write_text("only\n1\n")
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "one.csv"))
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "sheet.xlsx"))


def test_roles_and_checks(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 1.0, "Oui")], "Date string, Produit string, Ventes double, Promo string")
    spec = detect_roles(df)
    assert (spec.date_col, spec.target_col, spec.cat_col, spec.promo_col, spec.stock_col) == ("Date", "Ventes", "Produit", "Promo", None)
    assert check_table(df, spec) is df
    assert SalesSpec("d", "y", "Aucune").cat_col is None
    for bad in (df.select("Date"), df.limit(0)):
        with pytest.raises(ValueError):
            check_table(bad)
    with pytest.raises(ValueError):
        check_table(df, SalesSpec("nope", "Ventes"))


def test_appended_batches_match_by_name(spark, tmp_path):
    path = str(tmp_path / "a")
    append_rows(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    append_rows(spark.createDataFrame([(2.5, 2)], "c double, a int"), path)
    assert sorted(values(read_appended(spark, path), "a", "b", "c")) == [(1, "x", None), (2, None, 2.5)]
    with pytest.raises(ValueError):
        export(read_appended(spark, path), str(tmp_path / "b"), "pdf")
