"""Date parsing and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted date patterns. Year-first is always year-month-day, anything else is day first.
DATE_PATTERNS = [
    "yyyy-M-d['T'][ ][H:m[:s]]",
    "yyyy/M/d[ H:m[:s]]",
    "d/M/yyyy[ H:m[:s]]",
    "d-M-yyyy[ H:m[:s]]",
    "d.M.yyyy[ H:m[:s]]",
    "d/M/yyyy h:m[:s] a",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
]
# Two-digit years; from 69 on they belong to the last century.
SHORT_YEARS = ["d/M/yy", "d-M-yy", "d.M.yy"]
CENTURY_FROM = 2069
# Spreadsheet serial dates count days from this origin; they are told apart by a large median.
SERIAL_ORIGIN = "1899-12-30"
SERIAL_MEDIAN = 10000


def text_to_timestamp(c: Column) -> Column:
    text = F.trim(c)
    tries = [F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in DATE_PATTERNS]
    # Longer ISO forms, such as fractions of a second; the cast alone would read a bare number as a year.
    iso = F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ]"), text.try_cast("timestamp_ntz"))
    short = [F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in SHORT_YEARS]
    short = [F.when(F.year(s) >= CENTURY_FROM, F.add_months(s.cast("date"), -1200).cast("timestamp_ntz")).otherwise(s) for s in short]
    return F.coalesce(*tries, iso, *short)


def serial_to_timestamp(c: Column) -> Column:
    """Days since the origin, the fraction being the time of day (to the microsecond)."""
    days = F.floor(c.cast("double"))
    seconds = F.round((c.cast("double") - days) * 86400, 6).cast("decimal(18,6)")
    origin = F.expr(f"timestamp_ntz'{SERIAL_ORIGIN} 00:00:00'")
    return origin + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), seconds)


def is_serial(df: DataFrame, column: str) -> bool:
    """Whether the median of a numeric column exceeds the serial threshold.

    One pass with counts and two extremes; the exact median itself is not needed: when exactly half of
    the values lie above, the median is the middle of the two values next to the threshold.
    """
    x = F.col(column).cast("double")
    row = df.select(x.alias("x")).agg(
        F.count("x").alias("n"),
        F.count_if(F.col("x") > SERIAL_MEDIAN).alias("above"),
        F.max(F.when(F.col("x") <= SERIAL_MEDIAN, F.col("x"))).alias("below"),
        F.min(F.when(F.col("x") > SERIAL_MEDIAN, F.col("x"))).alias("next"),
    ).first()
    if row["n"] == 0 or 2 * row["above"] < row["n"]:
        return False
    return 2 * row["above"] > row["n"] or (row["below"] + row["next"]) / 2 > SERIAL_MEDIAN


def parse_dates(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Turn a text, numeric, date or timestamp column into TIMESTAMP_NTZ; unreadable values become NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        if not is_serial(df, column):
            raise ValueError(f"numeric column {column!r} holds no spreadsheet serial dates")
        parsed = serial_to_timestamp(F.col(column))
    elif isinstance(kind, T.StringType):
        parsed = text_to_timestamp(F.col(column))
    else:
        parsed = F.col(column).cast("timestamp_ntz")
    return df.withColumn(into or column, parsed)


def unreadable_dates(df: DataFrame, column: str) -> DataFrame:
    """``(column, entries, missing, unreadable)``: how many values :func:`parse_dates` turns into NULL."""
    raw = F.col("_raw")
    parsed = parse_dates(df.withColumn("_raw", F.col(column)), column)
    return parsed.select(
        F.lit(column).alias("column"), raw.isNull().alias("_none"), (raw.isNotNull() & F.col(column).isNull()).alias("_bad")
    ).groupBy("column").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("_none").alias("missing"), F.count_if("_bad").alias("unreadable")
    )


def day_of(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("date")


def week_label(c: str | Column) -> Column:
    """Sunday that closes the week of a date."""
    return F.next_day(F.date_sub(day_of(c), 1), "SU")


def calendar_columns(c: str | Column) -> dict[str, Column]:
    d = day_of(c)
    return {
        "day": F.day(d),
        "month": F.month(d),
        "weekday": F.weekday(d),
        "dayofyear": F.dayofyear(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "weekend": (F.weekday(d) >= 5).cast("int"),
    }


def calendar_features(df: DataFrame, column: str) -> DataFrame:
    """Day, month, weekday (Monday = 0), day of year, quarter, year, weekend flag, month and day names."""
    names = {"month_name": F.date_format(day_of(column), "MMMM"), "day_name": F.date_format(day_of(column), "EEEE")}
    return df.withColumns({**calendar_columns(column), **names})
