"""Alert rules, checks, history, stream, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.registry import oracle, query, rounded
from tidemark.functions.validation import EMAIL_PATTERN, PHONE_PATTERN
from tidemark.operators import alerts
from tidemark.operators.reports import general_report
from tidemark.session import scratch_path
from tidemark.streaming.alerts import alert_stream, read_alerts

REQUESTS = """SELECT c_name AS name, email, CASE WHEN contact_id % 3 = 0 THEN '' ELSE phone END AS phone,
    CASE contact_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'SMALL' WHEN 2 THEN 'LARGE' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'MEDIUM'
      WHEN 5 THEN 'ECONOMY' ELSE 'STANDARD' END AS category,
    CASE WHEN contact_id % 4 <> 0 THEN CAST(contact_id % 60 AS DOUBLE) END AS up,
    CAST(contact_id % 50 - CASE WHEN contact_id % 11 = 0 THEN 50 ELSE 0 END AS DOUBLE) AS down FROM contacts"""
RULES = f"""SELECT name, email, CASE WHEN phone = '' THEN 'N/A' ELSE phone END AS phone, coalesce(category, 'Globale') AS category,
    coalesce(up, 10) AS up, coalesce(down, 10) AS down, reason IS NULL AS accepted, reason FROM (
    SELECT *, CASE WHEN name IS NULL OR email IS NULL THEN 'name and e-mail are required'
      WHEN NOT regexp_full_match(email, '{EMAIL_PATTERN}') THEN 'invalid e-mail'
      WHEN phone <> '' AND NOT regexp_full_match(phone, '{PHONE_PATTERN}') THEN 'invalid phone'
      WHEN up < 0 OR down < 0 THEN 'negative threshold' END AS reason FROM ({REQUESTS}))"""
CHANGES = """SELECT *, (y - p) / nullif(p, 0) * 100 AS variation FROM (
    SELECT *, lag(y) OVER (PARTITION BY category ORDER BY ds) AS p, row_number() OVER (PARTITION BY category ORDER BY ds DESC) AS back FROM (
    SELECT product AS category, sale_date AS ds, CAST(sum(amount) AS DOUBLE) AS y FROM sales GROUP BY 1, 2
    UNION ALL SELECT 'Globale', sale_date, CAST(sum(amount) AS DOUBLE) FROM sales GROUP BY 2))"""
LABEL = """concat(CASE WHEN abs(variation) <= 5 THEN 'slight' WHEN abs(variation) <= 10 THEN 'moderate' ELSE 'strong' END, ' ',
    CASE WHEN variation > 0 THEN 'rise' ELSE 'fall' END)"""


def _requests(spark, d):
    k = F.col("contact_id")
    names = ["SMALL", "LARGE", "PROMO", "MEDIUM", "ECONOMY", "STANDARD"]
    category = F.lit(None).cast("string")
    for i, name in enumerate(names, 1):
        category = F.when(k % 7 == i, name).otherwise(category)
    return fx.contacts(spark, d).select(
        F.col("c_name").alias("name"), "email", F.when(k % 3 == 0, "").otherwise(F.col("phone")).alias("phone"),
        category.alias("category"), F.when(k % 4 != 0, (k % 60).cast("double")).alias("up"),
        (k % 50 - F.when(k % 11 == 0, 50).otherwise(0)).cast("double").alias("down"))


def _rules(spark, d):
    return alerts.register_rules(_requests(spark, d)).where("accepted")


@query("alert_rules", oracle(RULES, "up down"))
def rules(spark, d):
    return rounded(alerts.register_rules(_requests(spark, d)))


@query("alert_check", oracle(f"""
    SELECT name, email, r.category, up, down, ds, variation, CASE WHEN variation IS NULL THEN 'not enough data' WHEN variation > up THEN 'up'
      WHEN variation < -down THEN 'down' ELSE 'none' END AS alert
    FROM ({RULES}) r LEFT JOIN (SELECT * FROM ({CHANGES}) WHERE back = 1) c ON c.category = r.category WHERE accepted""", "up down variation"))
def check(spark, d):
    series = alerts.alert_series(fx.sales(spark, d), fx.SPEC)
    out = alerts.alert_check(series, _rules(spark, d))
    return rounded(out.select("name", "email", "category", "up", "down", "ds", "variation", "alert"))


@query("alert_history", oracle(f"""
    WITH t AS (SELECT category, min(up) AS up, min(down) AS down FROM ({RULES}) WHERE accepted GROUP BY 1)
    SELECT c.category, ds, variation, {LABEL} AS label FROM ({CHANGES}) c JOIN t ON t.category = c.category
    WHERE variation > up OR variation < -down""", "variation"))
def history(spark, d):
    return rounded(alerts.alert_history(alerts.alert_series(fx.sales(spark, d), fx.SPEC), _rules(spark, d)))


@query("alert_stream", oracle(f"""
    WITH e AS (SELECT event_type AS category, CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY 1, 2),
    w AS (SELECT * FROM e UNION ALL SELECT 'Globale', ds, sum(y) FROM e GROUP BY 2),
    c AS (SELECT category, ds, (y - p) / nullif(p, 0) * 100 AS variation
          FROM (SELECT *, lag(y) OVER (PARTITION BY category ORDER BY ds) AS p FROM w))
    SELECT category, ds, variation, {LABEL} AS label FROM c WHERE abs(variation) > 10""", "variation"))
def stream(spark, d):
    """Alerts of all days, closed and open, when the stored events are used up."""
    schema = fx.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    categories = ["Globale", "click", "view", "purchase", "signup", "error"]
    path = scratch_path(spark, "stream")
    run = alert_stream(source, alerts.default_rule(fx.table(spark, d, "events"), categories), path, "ts", "event_type", "value")
    run.awaitTermination()
    return rounded(read_alerts(spark, path))


P = "SELECT * FROM sales WHERE sale_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"
TOTAL = "CAST(sum(amount) AS DOUBLE)"


@query("general_report", oracle(f"""
    WITH p AS ({P}), d AS (SELECT *, CAST(amount AS DOUBLE) AS x FROM p),
    k AS (SELECT CAST(count(*) AS DOUBLE) AS entries, {TOTAL} AS total, {TOTAL} / count(*) AS mean, quantile_cont(x, 0.5) AS median,
                 stddev_samp(x) AS std FROM d),
    g AS (SELECT avg((x - q) / nullif(q, 0)) * 100 AS growth
          FROM (SELECT x, lag(x) OVER (ORDER BY sale_date, order_id, line_no, part_id, supp_id) AS q FROM d)),
    c AS (SELECT product, {TOTAL} AS v, row_number() OVER (ORDER BY {TOTAL} DESC, product) AS t,
                 row_number() OVER (ORDER BY {TOTAL}, product) AS b FROM p GROUP BY 1),
    m AS (SELECT month(sale_date) AS m, sum(amount) AS v FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT 1 AS section_no, 'summary' AS section, u.position, u.label, NULL::VARCHAR AS detail, u.value FROM k CROSS JOIN g,
      LATERAL (VALUES (1, 'entries', entries), (2, 'total', total), (3, 'mean', mean), (4, 'median', median), (5, 'std', std),
                      (6, 'growth', growth)) u(position, label, value)
    UNION ALL SELECT 2, 'top_categories', CAST(t AS INTEGER), 'category', product, v FROM c WHERE t <= 5
    UNION ALL SELECT 2, 'bottom_categories', CAST(b AS INTEGER), 'category', product, v FROM c WHERE b <= 5
    UNION ALL SELECT 3, 'insights', 1, 'best_month', NULL, CAST(m AS DOUBLE) FROM m
    UNION ALL SELECT 3, 'insights', 2, 'star_category', product, v FROM c WHERE t = 1
    UNION ALL SELECT 3, 'insights', 3, 'weak_category', product, v FROM c WHERE b = 1""", "value"))
def report(spark, d):
    return rounded(general_report(fx.sales(spark, d), fx.SPEC, "1996-01-01", "1999-12-31"))
