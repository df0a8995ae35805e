"""KPIs and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import day_of, week_label
from tidemark.functions.numeric import as_double, change, grade, mean, pearson, percent_of, total
from tidemark.plans.ordered import ROWS_PER_BUCKET, previous_value
from tidemark.plans.quantiles import quantiles
from tidemark.plans.stages import steady, whole_sum
from tidemark.spec import PROMO_NO, PROMO_YES, SalesSpec

# Thresholds and labels of the verdicts.
LIFT_STEPS = [(20, "very effective"), (0, "moderate")]
LIFT_OTHER = "weak or negative"
GROWTH_STEPS = [(5, "strong"), (0, "moderate")]
GROWTH_OTHER = "attention"
CORRELATION_STEPS = [(0.7, "strong"), (0.4, "moderate")]
CORRELATION_OTHER = "weak"
POTENTIAL_STEPS = [(50, "Promouvoir"), (20, "Optimiser")]
POTENTIAL_OTHER = "Surveiller"
STABILITY = [(20, "Excellent"), (40, "Bon")]
STABILITY_OTHER = "Volatile"
STOCK_LEVELS = [(0.3, "critical"), (0.5, "low")]
STOCK_OTHER = "ok"


def with_key(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose grouping columns are all present: groups never form on NULL keys."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def kpi_summary(df: DataFrame, spec: SalesSpec, approx: bool = False) -> DataFrame:
    """Total, mean, distinct categories, entries, median and standard deviation, as one row."""
    y = spec.target_col
    df = steady(df.select(y, *([spec.cat_col] if spec.cat_col else [])), "kpi")
    distinct = F.lit(None).cast("bigint")
    if spec.cat_col:
        distinct = F.approx_count_distinct(spec.cat_col) if approx else F.count_distinct(F.col(spec.cat_col))
    one = df.agg(
        total(y).alias("total"),
        mean(y).alias("mean"),
        distinct.alias("categories"),
        F.count(F.lit(1)).alias("entries"),
        F.stddev_samp(as_double(y)).alias("std"),
    )
    return one.withColumn("median", quantiles(df, [y], [0.5], approx=approx).select("q0").scalar())


def pct_change(
    df: DataFrame, spec: SalesSpec, by: list[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``pct_change`` against the row before, in date order; a missing value repeats the last one."""
    df = with_key(df, *by)
    out = previous_value(df, list(by), spec.order, as_double(spec.target_col), rows_per_bucket)
    out = out.withColumn("pct_change", change(F.col("_filled"), F.col("_previous")))
    return out.withColumn("zero_base", F.coalesce(F.col("_previous") == 0, F.lit(False))).drop("_filled", "_previous")


def _growth_columns():
    return [
        (F.avg("pct_change") * 100).alias("growth"),
        F.count_if("zero_base").alias("n_zero_base"),
    ]


def growth_mean(df: DataFrame, spec: SalesSpec, by: list[str] = (), **kw) -> DataFrame:
    """Mean row-to-row change in percent; rows after a zero are skipped and counted in ``n_zero_base``."""
    needed = df.select(*by, *spec.order, spec.target_col)
    return pct_change(needed, spec, by, **kw).groupBy(*by).agg(*_growth_columns())


def growth_verdict(df: DataFrame, spec: SalesSpec, **kw) -> DataFrame:
    out = growth_mean(df, spec, **kw)
    return out.withColumn("verdict", grade(F.col("growth"), GROWTH_STEPS, GROWTH_OTHER))


def daily_totals(df: DataFrame, spec: SalesSpec, by: list[str] = (), fill: str | None = None) -> DataFrame:
    """Sum per day as ``(*by, date, value)``; ``fill="zero"`` adds the missing days of every group."""
    df = with_key(df, spec.date_col, *by)
    daily = df.groupBy(*by, day_of(spec.date_col).alias("date")).agg(total(spec.target_col).alias("value"))
    if fill is None:
        return daily
    if fill != "zero":
        raise ValueError(f"unknown fill {fill!r}")
    # Each day also yields the gap that follows it, so no calendar has to be joined.
    follow = F.lead("date").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("date"))
    span = daily.withColumn("_next", F.coalesce(F.date_sub(follow, 1), F.col("date")))
    days = span.select(*by, "value", F.posexplode(F.sequence("date", "_next")).alias("_gap", "date"))
    return days.select(*by, "date", F.when(F.col("_gap") == 0, F.col("value")).otherwise(0.0).alias("value"))


def category_performance(df: DataFrame, spec: SalesSpec, **kw) -> DataFrame:
    """Total, mean, max, min and growth of every category."""
    needed = df.select(spec.cat_col, *spec.order, spec.target_col)
    y = spec.target_col
    return pct_change(needed, spec, [spec.cat_col], **kw).groupBy(spec.cat_col).agg(
        total(y).alias("total"),
        mean(y).alias("mean"),
        F.max(as_double(y)).alias("max"),
        F.min(as_double(y)).alias("min"),
        *_growth_columns(),
    )


def share_of_total(grouped: DataFrame, column: str = "total", into: str = "share") -> DataFrame:
    """Add the share in percent of the column's sum, read as a scalar so that the groups stay distributed."""
    grouped = steady(grouped, "groups")
    return grouped.withColumn(into, percent_of(F.col(column), whole_sum(grouped, column)))


def region_kpis(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Total, mean and share of the total for every region; rows without a region count in the total only."""
    y = spec.target_col
    grouped = df.groupBy(spec.region_col).agg(total(y).alias("total"), mean(y).alias("mean"))
    return with_key(share_of_total(grouped), spec.region_col)


def region_by_category(df: DataFrame, spec: SalesSpec) -> DataFrame:
    keys = [spec.region_col, spec.cat_col]
    return with_key(df, *keys).groupBy(*keys).agg(total(spec.target_col).alias("total"))


def region_comparison(df: DataFrame, spec: SalesSpec) -> DataFrame:
    y = spec.target_col
    return with_key(df, spec.region_col).groupBy(spec.region_col).agg(
        total(y).alias("total"), mean(y).alias("mean"), F.count(y).alias("transactions")
    )


def promo_stats(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Total, mean and count with and without promotion; 0 for a flag that does not occur."""
    y, flag = F.col(spec.target_col), F.col(spec.promo_col)
    parts = {}
    for i, value in enumerate((PROMO_YES, PROMO_NO)):
        hit = F.when(flag == value, y)
        parts |= {f"t{i}": total(hit), f"m{i}": F.coalesce(mean(hit), F.lit(0.0)), f"c{i}": F.count(hit)}
    one = df.agg(*[c.alias(n) for n, c in parts.items()])
    rows = [
        F.struct(F.lit(v).alias("promo"), F.col(f"t{i}").alias("total"), F.col(f"m{i}").alias("mean"),
                 F.col(f"c{i}").alias("transactions"))
        for i, v in enumerate((PROMO_YES, PROMO_NO))
    ]
    return one.select(F.inline(F.array(*rows)))


def promo_lift(df: DataFrame, spec: SalesSpec, by: list[str] = ()) -> DataFrame:
    """Difference of the means with and without promotion in percent; NULL unless the latter is positive."""
    y, flag = F.col(spec.target_col), F.col(spec.promo_col)
    out = with_key(df, *by).groupBy(*by).agg(
        mean(F.when(flag == PROMO_YES, y)).alias("mean_with"), mean(F.when(flag == PROMO_NO, y)).alias("mean_without")
    )
    lift = F.when(
        F.col("mean_without") > 0, (F.col("mean_with") - F.col("mean_without")) / F.col("mean_without") * 100
    )
    verdict = F.when(F.col("lift").isNotNull(), grade(F.col("lift"), LIFT_STEPS, LIFT_OTHER))
    return out.withColumn("lift", lift).withColumn("verdict", F.coalesce(verdict, F.lit("not computable")))


def promo_weekly(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Weekly means with and without promotion, weeks ending on Sunday, weeks without sales included."""
    y, flag = F.col(spec.target_col), F.col(spec.promo_col)
    weekly = with_key(df, spec.date_col).groupBy(week_label(spec.date_col).alias("week")).agg(
        mean(F.when(flag == PROMO_YES, y)).alias("mean_with"), mean(F.when(flag == PROMO_NO, y)).alias("mean_without")
    )
    bounds = weekly.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    weeks = bounds.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    return weeks.join(weekly, "week", "left")


def stock_status(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Last and mean stock per category, variation in percent and stock level."""
    s = spec.stock_col
    by = [spec.cat_col] if spec.cat_col else []
    out = with_key(df, *by).groupBy(*by).agg(
        F.max_by(as_double(s), F.struct(*spec.order)).alias("stock"), mean(s).alias("mean_stock")
    )
    level = F.when(F.col("stock") < F.col("mean_stock") * STOCK_LEVELS[0][0], STOCK_LEVELS[0][1]).when(
        F.col("stock") < F.col("mean_stock") * STOCK_LEVELS[1][0], STOCK_LEVELS[1][1]
    )
    return out.withColumn("variation", change(F.col("stock"), F.col("mean_stock")) * 100).withColumn(
        "level", level.otherwise(STOCK_OTHER)
    )


def stock_correlation(df: DataFrame, spec: SalesSpec) -> DataFrame:
    out = df.agg(pearson(spec.stock_col, spec.target_col).alias("correlation"))
    return out.withColumn("strength", grade(F.abs("correlation"), CORRELATION_STEPS, CORRELATION_OTHER))


def _category_totals(df: DataFrame, spec: SalesSpec) -> DataFrame:
    y = spec.target_col
    grouped = with_key(df, spec.cat_col).groupBy(spec.cat_col).agg(total(y).alias("total"), mean(y).alias("mean"))
    return steady(grouped, "groups")


def _ranked(df: DataFrame, order, k: int, into: str = "rank") -> DataFrame:
    """The first ``k`` rows of an order, numbered; only those ``k`` rows reach the window."""
    return df.orderBy(*order).limit(k).withColumn(into, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def top_bottom_categories(df: DataFrame, spec: SalesSpec, k: int = 5) -> DataFrame:
    """The ``k`` best and ``k`` worst categories by total; the worst has rank 1 of its side."""
    totals = _category_totals(df, spec).select(spec.cat_col, "total")
    best = _ranked(totals, [F.col("total").desc(), F.col(spec.cat_col)], k).withColumn("side", F.lit("top"))
    worst = _ranked(totals, [F.col("total").asc(), F.col(spec.cat_col)], k).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def category_insights(df: DataFrame, spec: SalesSpec, k: int | None = 3) -> DataFrame:
    """Total, mean, deviation, coefficient of variation, share and stability of the top ``k`` categories."""
    y = spec.target_col
    grouped = df.groupBy(spec.cat_col).agg(
        total(y).alias("total"), mean(y).alias("mean"), F.stddev_samp(as_double(y)).alias("std")
    )
    grouped = steady(grouped, "groups")
    whole = whole_sum(grouped, "total")
    grouped = with_key(grouped, spec.cat_col).withColumns({c: F.round(c, 2) for c in ("total", "mean", "std")})
    cv = F.round(percent_of(F.col("std"), F.col("mean")), 2)
    stable = F.when(F.col("cv") < STABILITY[0][0], STABILITY[0][1]).when(F.col("cv") < STABILITY[1][0], STABILITY[1][1])
    out = grouped.withColumn("cv", cv)
    out = out.withColumn("share", F.coalesce(percent_of(F.col("total"), whole), F.lit(0.0)))
    out = out.withColumn("stability", stable.otherwise(STABILITY_OTHER))
    return out if k is None else _ranked(out, [F.col("total").desc(), F.col(spec.cat_col)], k)


def growth_potential(df: DataFrame, spec: SalesSpec, k: int = 3) -> DataFrame:
    """How far the ``k`` weakest categories stay below the mean of the category means, with an action."""
    means = _category_totals(df, spec).select(
        spec.cat_col, F.round("total", 2).alias("total"), F.round("mean", 2).alias("mean")
    )
    average = means.agg(F.avg("mean")).scalar()
    gap = F.coalesce(percent_of(average - F.col("mean"), F.col("mean")), F.lit(0.0))
    weak = _ranked(means.withColumn("potential", gap), [F.col("total").asc(), F.col(spec.cat_col)], k)
    return weak.withColumn("action", grade(F.col("potential"), POTENTIAL_STEPS, POTENTIAL_OTHER))


def audit_stats(logins: DataFrame, users: DataFrame, demos: DataFrame, success: str = "success") -> DataFrame:
    """Counts of users, demo requests, log-ins and successful log-ins, as one row."""
    ok = F.col(success).cast("boolean")
    return logins.agg(F.count(F.lit(1)).alias("logins"), F.count_if(ok).alias("login_success")).select(
        users.agg(F.count(F.lit(1))).scalar().alias("users"),
        demos.agg(F.count(F.lit(1))).scalar().alias("demos"),
        "logins",
        "login_success",
    )


def audit_latest(
    df: DataFrame, columns: list[str], created: str = "created_at", n: int = 500, cut: dict[str, int] | None = None
) -> DataFrame:
    """The newest ``n`` records; long texts in ``cut`` are shortened for display."""
    shown = [F.substring(c, 1, cut[c]).alias(c) if cut and c in cut else F.col(c) for c in columns]
    ties = [c for c in columns if c != created]
    return df.orderBy(F.desc_nulls_last(created), *ties).limit(n).select(*shown)


def user_lookup(df: DataFrame, email: str, column: str = "email") -> DataFrame:
    return df.where(F.col(column) == email).limit(1)


def users_known(df: DataFrame, emails: DataFrame, column: str = "email") -> DataFrame:
    """Batch form: the records whose address occurs in ``emails``."""
    return df.join(emails.select(column).distinct(), column, "left_semi")
