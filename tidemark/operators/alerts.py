"""Alert rules, checks and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import day_of
from tidemark.functions.numeric import change, total
from tidemark.functions.validation import valid_email, valid_phone
from tidemark.operators.aggregates import with_key
from tidemark.plans.lookups import lookup_join
from tidemark.spec import SalesSpec

# Defaults of a subscription and the name of the whole-table series.
NO_PHONE = "N/A"
WHOLE = "Globale"
DEFAULT_THRESHOLD = 10.0


def _blank(c: str):
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def register_rules(df: DataFrame) -> DataFrame:
    """Check subscriptions ``(name, email, phone, category, up, down)``.

    Adds ``accepted`` and ``reason``; accepted rows carry the defaults for phone, category and thresholds.
    """
    reason = (
        F.when(_blank("name") | _blank("email"), "name and e-mail are required")
        .when(~valid_email("email"), "invalid e-mail")
        .when(~_blank("phone") & ~valid_phone("phone"), "invalid phone")
        .when((F.col("up") < 0) | (F.col("down") < 0), "negative threshold")
    )
    out = df.withColumn("reason", reason)
    return out.select(
        "name",
        "email",
        F.when(_blank("phone"), NO_PHONE).otherwise(F.col("phone")).alias("phone"),
        F.when(_blank("category"), WHOLE).otherwise(F.col("category")).alias("category"),
        F.coalesce("up", F.lit(DEFAULT_THRESHOLD)).alias("up"),
        F.coalesce("down", F.lit(DEFAULT_THRESHOLD)).alias("down"),
        F.col("reason").isNull().alias("accepted"),
        "reason",
    )


def alert_series(df: DataFrame, spec: SalesSpec) -> DataFrame:
    """Daily totals ``(category, ds, y)`` of every category and of the whole table."""
    keyed = with_key(df, spec.date_col)
    ds = day_of(spec.date_col).alias("ds")
    if not spec.cat_col:
        return keyed.groupBy(F.lit(WHOLE).alias("category"), ds).agg(total(spec.target_col).alias("y"))
    daily = keyed.groupBy(F.col(spec.cat_col).alias("category"), ds).agg(F.sum(spec.target_col).alias("y"))
    whole = daily.groupBy(F.lit(WHOLE).alias("category"), "ds").agg(F.sum("y").alias("y"))
    out = daily.where(F.col("category").isNotNull()).unionByName(whole.select("category", "ds", "y"))
    return out.withColumn("y", F.coalesce(F.col("y").cast("double"), F.lit(0.0)))


def variations(series: DataFrame) -> DataFrame:
    """Change in percent against the point before, per category."""
    w = Window.partitionBy("category").orderBy("ds")
    return series.withColumn("variation", change(F.col("y"), F.lag("y").over(w)) * 100)


def alert_check(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule against the last change of its category; NULL variation means too little data."""
    w = Window.partitionBy("category").orderBy(F.col("ds").desc())
    two = series.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= 2)
    last = two.groupBy("category").agg(
        F.max("ds").alias("ds"),
        (change(F.max(F.when(F.col("_back") == 1, F.col("y"))), F.max(F.when(F.col("_back") == 2, F.col("y")))) * 100).alias(
            "variation"
        ),
    )
    # Rules pile up on popular categories; the other side has one row per category.
    out = lookup_join(rules, last, ["category"], "left")
    state = (
        F.when(F.col("variation").isNull(), "not enough data")
        .when(F.col("variation") > F.col("up"), "up")
        .when(F.col("variation") < -F.col("down"), "down")
        .otherwise("none")
    )
    return out.withColumn("alert", state)


def tightest_rules(rules: DataFrame) -> DataFrame:
    """The lowest thresholds of every category: what any of its rules would report."""
    return rules.groupBy("category").agg(F.min("up").alias("up"), F.min("down").alias("down"), F.count(F.lit(1)).alias("rules"))


def size_label(variation):
    size = F.when(F.abs(variation) <= 5, "slight").when(F.abs(variation) <= 10, "moderate").otherwise("strong")
    return F.concat_ws(" ", size, F.when(variation > 0, "rise").otherwise("fall"))


def breaches(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes beyond the thresholds; categories without a rule are not watched."""
    joined = lookup_join(changed, tightest_rules(rules), ["category"])
    hit = (F.col("variation") > F.col("up")) | (F.col("variation") < -F.col("down"))
    return joined.where(hit).select("category", "ds", "variation", size_label(F.col("variation")).alias("label"))


def alert_history(series: DataFrame, rules: DataFrame) -> DataFrame:
    """All past changes that some rule of their category reports."""
    return breaches(variations(series), rules)


def default_rule(df: DataFrame, categories: list[str] = (WHOLE,), threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """A rule table with one threshold for the named categories."""
    rows = [(c, float(threshold), float(threshold)) for c in categories]
    return df.sparkSession.createDataFrame(rows, "category string, up double, down double")
