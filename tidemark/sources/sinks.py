"""Writing results and appending records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """Write as CSV with header, JSON lines with ISO dates, parquet, or one text column as plain text."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        # Quotes are doubled, as spreadsheets and other readers expect.
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    elif fmt == "txt":
        writer.text(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
    return path


def append_rows(df: DataFrame, path: str) -> str:
    """Append records to a stored table, creating it when absent; old files are never rewritten."""
    df.write.mode("append").parquet(path)
    return path


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All appended records; columns are matched by name and NULL where a batch did not have them."""
    return spark.read.option("mergeSchema", True).parquet(path)


def report_text(report: DataFrame) -> DataFrame:
    """Report rows as one text column, one line per row, in section order within each partition."""
    number = F.coalesce(F.format_number("value", 2), F.lit(""))
    line = F.concat_ws(" ", F.concat("section", F.lit(" |"), F.format_string("%5d", "position"), F.lit(" |")),
                       "label", "detail", number)
    keys = [c for c in ("series_key", "model") if c in report.columns]
    return report.orderBy(*keys, "section_no", "position").select(F.trim(line).alias("value"))
