"""The stream reports what the history reports, and drops late records."""

import datetime as dt

from tidemark.operators.alerts import WHOLE, alert_history, alert_series, default_rule
from tidemark.spec import SalesSpec
from tidemark.streaming.alerts import alert_stream, read_alerts

SCHEMA = "ts timestamp_ntz, cat string, y double"


def run(spark, source, path, rules):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    alert_stream(stream, rules, path, "ts", "cat", "y", "1 day").awaitTermination()


def rows(df):
    return sorted((r["category"], r["ds"], round(r["variation"], 6), r["label"]) for r in df.collect())


def write(spark, folder, n, records):
    # One file per batch, read in order of writing time.
    spark.createDataFrame(records, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_history_and_resumes(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1, 6)
    records = [(start + dt.timedelta(days=d, hours=h), c, float((d * 7 + h * 3 + len(c)) % 11 + 1))
               for d in range(12) for h in (0, 9) for c in ("a", "bb")]
    rules = default_rule(spark.range(1), ["a", "bb", WHOLE])
    half = len(records) // 2
    write(spark, source, 1, records[:half])
    run(spark, source, path, rules)
    half_history = alert_history(alert_series(spark.createDataFrame(records[:half], SCHEMA), SalesSpec("ts", "y", "cat")), rules)
    assert rows(read_alerts(spark, path)) == rows(half_history)
    first = read_alerts(spark, path, open_days=False).count()
    write(spark, source, 2, records[half:])
    # A record for a day that is closed already must not change anything.
    write(spark, source, 3, [(start, "a", 1000.0)])
    run(spark, source, path, rules)
    df = spark.createDataFrame(records, SCHEMA)
    expected = alert_history(alert_series(df, SalesSpec("ts", "y", "cat")), rules)
    # The watermark stays a day behind the last record, so the last two days are still open.
    closed = expected.where("ds <= date'2024-01-10'")
    assert rows(read_alerts(spark, path, open_days=False)) == rows(closed)
    assert rows(read_alerts(spark, path)) == rows(expected)
    assert 0 < first < closed.count() < expected.count()


def test_late_records_change_open_days(spark, tmp_path):
    """A day between two known ones, a record without a category, and a correction of an open day."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    batches = [
        [(day(1), "a", 10.0), (day(3), "a", 20.0), (day(3), None, 5.0)],
        [(day(2, 20), "a", 40.0), (day(3, 9), "a", 1.0)],
        [(day(9), "bb", 1.0), (day(4), "a", 3.0)],
        [(day(8, 5), "a", 1.0), (day(2), "a", 500.0)],
    ]
    rules = default_rule(spark.range(1), ["a", "bb", WHOLE])
    seen = []
    for n, records in enumerate(batches):
        write(spark, source, n, records)
        run(spark, source, path, rules)
        seen += records if n < 3 else records[:1]
        expected = alert_history(alert_series(spark.createDataFrame(seen, SCHEMA), SalesSpec("ts", "y", "cat")), rules)
        assert rows(read_alerts(spark, path)) == rows(expected)
    assert {r["ds"].day for r in read_alerts(spark, path, open_days=False).collect()} == {2, 3, 4}
