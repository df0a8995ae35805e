"""Sources, sinks, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.registry import oracle, query, rounded
from tidemark.functions.dates import calendar_features, parse_dates, unreadable_dates
from tidemark.functions.numeric import total
from tidemark.functions.validation import valid_email, valid_phone, validity_counts
from tidemark.operators import cleaning
from tidemark.operators.aggregates import kpi_summary
from tidemark.operators.reports import general_report
from tidemark.session import scratch_path
from tidemark.sources import sinks, tables
from tidemark.spec import SalesSpec, check_table, detect_roles, numeric_columns

CSV_COLUMNS = ["sale_date", "order_id", "product", "region", "amount", "quantity", "promo"]
BY_STATUS = "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1"
BY_PRODUCT = """SELECT product, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, sum(quantity) AS quantity,
    min(sale_date) AS first_date FROM sales GROUP BY 1"""


def _by_status(df):
    return rounded(df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


def _by_product(df):
    return rounded(
        df.groupBy("product").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("total"),
            F.sum("quantity").alias("quantity"), F.min(F.col("sale_date").cast("date")).alias("first_date"),
        ), 2
    )


@query("load_delimited", oracle(BY_PRODUCT, "total quantity", 2))
def load_delimited(spark, d):
    path = scratch_path(spark, "semicolon")
    fx.sales(spark, d).select(*CSV_COLUMNS).write.option("header", True).option("sep", ";").csv(path)
    return _by_product(tables.load_delimited(spark, path))


@query("load_delimited_cases", """
    SELECT concat('say "', o_orderpriority, '"; first', chr(10), 'second, é') AS note, count(*) AS n,
           count(CASE WHEN o_orderkey % 10 <> 3 THEN 1 END) AS priced,
           round(sum(CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice END) + CAST(3e-05 AS DOUBLE), 2) + 0.0 AS total
    FROM orders GROUP BY 1""")
def load_delimited_cases(spark, d):
    """Quotes, separators and line breaks in quotes, words for missing values, letters beyond ASCII."""
    note = F.concat(F.lit('say "'), "o_orderpriority", F.lit('"; first\nsecond, é'))
    price = F.when(F.col("o_orderkey") % 10 == 3, F.element_at(F.array(*map(F.lit, ["NA", "n/a", "nan", "NULL"])),
                   (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise(F.col("o_totalprice").cast("string"))
    out = fx.table(spark, d, "orders").select("o_orderkey", note.alias("note"), price.alias("price"))
    read = tables.load_delimited(spark, sinks.export(out, scratch_path(spark, "cases"), "csv"))
    return rounded(read.groupBy("note").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.sum("price").alias("total")), 2)


@query("load_parquet", oracle(BY_STATUS, "total", 2))
def load_parquet(spark, d):
    return _by_status(tables.load_table(spark, f"{d}/orders.parquet"))


@query("load_dispatch", oracle(
    f"SELECT f.fmt, x.* FROM ({BY_STATUS}) x CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) f(fmt)", "total", 2))
def load_dispatch(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = sinks.export(orders, f"{scratch_path(spark, 'orders')}.{fmt}", fmt)
        part = _by_status(tables.load_table(spark, path)).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query("clean_names", oracle(BY_STATUS, "total", 2))
def clean_names(spark, d):
    orders = fx.table(spark, d, "orders")
    return _by_status(tables.clean_names(orders.toDF(*[f"  {c} " for c in orders.columns])))


@query("check_table", oracle("SELECT count(*) AS n FROM sales"))
def check(spark, d):
    return check_table(fx.sales(spark, d), fx.SPEC).agg(F.count(F.lit(1)).alias("n"))


_PROFILE = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("table_profile", oracle(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({i} AS INTEGER) AS position, '{t}' AS type, count(*) AS row_count,
        count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM orders"""
    for i, (c, t) in enumerate(_PROFILE))))
def table_profile(spark, d):
    return tables.table_profile(fx.table(spark, d, "orders"), distinct="exact")


@query("numeric_columns", oracle(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS present FROM orders""" for c in ("o_orderkey", "o_custkey", "o_totalprice"))))
def numeric(spark, d):
    orders = fx.table(spark, d, "orders")
    names = numeric_columns(orders)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in names]
    return orders.agg(*[F.count(c).alias(c) for c in names]).select(F.inline(F.array(*cells)))


@query("detect_roles", oracle("""
    SELECT 'sale_date' AS date_col, 'amount' AS target_col, 'Produit' AS cat_col, 'Region' AS region_col,
           CAST(sum(amount) AS DOUBLE) AS total, count(DISTINCT product) AS categories, count(*) AS entries FROM sales""", "total"))
def roles(spark, d):
    df = fx.sales(spark, d).select(
        "sale_date", "amount", F.col("product").alias("Produit"), F.col("region").alias("Region"),
        F.col("promo").alias("Promo"), F.col("stock").alias("Stock"),
    )
    spec = detect_roles(df)
    named = {r: F.lit(getattr(spec, r)) for r in ("date_col", "target_col", "cat_col", "region_col")}
    out = df.agg(total(spec.target_col).alias("total"), F.count_distinct(F.col(spec.cat_col)).alias("categories"),
                 F.count(F.lit(1)).alias("entries"))
    return rounded(out.withColumns(named))


@query("write_csv", oracle(BY_PRODUCT, "total quantity", 2))
def write_csv(spark, d):
    path = sinks.export(fx.sales(spark, d).select(*CSV_COLUMNS), scratch_path(spark, "csv"), "csv")
    return _by_product(tables.load_table(spark, path, "csv", encoding="UTF-8"))


@query("write_json", oracle(BY_PRODUCT, "total quantity", 2))
def write_json(spark, d):
    path = sinks.export(fx.sales(spark, d).select(*CSV_COLUMNS), scratch_path(spark, "json"), "json")
    return _by_product(tables.load_table(spark, path, "json"))


@query("append_rows", oracle("""
    SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total, count(CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END)
           AS priorities FROM orders GROUP BY 1""", "total", 2))
def append_rows(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "appended")
    sinks.append_rows(orders.where("o_orderkey % 2 = 0").drop("o_orderpriority"), path)
    sinks.append_rows(orders.where("o_orderkey % 2 = 1"), path)
    read = sinks.read_appended(spark, path)
    return rounded(read.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.count("o_orderpriority").alias("priorities")), 2)


@query("report_rows", oracle("""
    WITH t AS (SELECT product, sum(amount) AS v FROM sales GROUP BY 1),
    k AS (SELECT count(*) AS n, sum(amount) AS s, CAST(sum(amount) AS DOUBLE) / count(*) AS m FROM sales),
    r AS (SELECT 'top_categories' AS section, row_number() OVER (ORDER BY v DESC, product) AS p, product, v FROM t
          UNION ALL SELECT 'bottom_categories', row_number() OVER (ORDER BY v, product), product, v FROM t)
    SELECT concat(section, ' |', printf('%5d', p), ' | category ', product, ' ', format('{:,.2f}', CAST(v AS DOUBLE))) AS value
    FROM r WHERE p <= 5
    UNION ALL SELECT concat('summary |    1 | entries ', format('{:,.2f}', CAST(n AS DOUBLE))) FROM k
    UNION ALL SELECT concat('summary |    2 | total ', format('{:,.2f}', CAST(s AS DOUBLE))) FROM k
    UNION ALL SELECT concat('summary |    3 | mean ', format('{:,.2f}', m)) FROM k"""))
def report_rows(spark, d):
    report = general_report(fx.sales(spark, d), fx.SPEC)
    lines = report.where("section like '%categories' or label in ('entries', 'total', 'mean')")
    return sinks.report_text(lines)


def _text_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    shapes = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss"]
    key = F.col("o_orderkey") % 6
    text = F.when(key == 5, F.concat(F.lit("n/a "), F.col("o_orderkey").cast("string")))
    for i, shape in enumerate(shapes):
        text = text.when(key == i, F.date_format(day, shape))
    return fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice", text.alias("order_date"))


@query("parse_dates_forms", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN NULL WHEN o_orderkey % 9 = 7
             THEN CAST(o_orderdate AS DATE) + INTERVAL 15 HOUR + INTERVAL 5 MINUTE ELSE CAST(o_orderdate AS DATE) END::TIMESTAMP AS day
    FROM orders""")
def date_forms(spark, d):
    """Two-digit years, month names, compact and 12-hour forms."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 9
    text = F.when(key == 8, F.lit("32/13/2024"))
    shapes = ["dd/MM/yy", "d-MM-yy", "dd-MMM-yyyy", "MMM d, yyyy", "yyyyMMdd", "d MMMM yyyy", "dd.MM.yy", "dd/MM/yyyy '3:05 PM'"]
    for i, shape in enumerate(shapes):
        text = text.when(key == i, F.date_format(day, shape))
    return parse_dates(fx.table(spark, d, "orders").select("o_orderkey", text.alias("day")), "day")


@query("unreadable_dates", """
    SELECT 'order_date' AS "column", count(*) AS entries, 0::BIGINT AS missing, count(CASE WHEN o_orderkey % 6 = 5 THEN 1 END) AS unreadable
    FROM orders""")
def unreadable(spark, d):
    return unreadable_dates(_text_dates(spark, d), "order_date")


DATED = "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE date_trunc('day', o_orderdate) END AS order_date FROM orders"


@query("parse_dates", oracle(f"SELECT o_orderkey, CAST(order_date AS TIMESTAMP) AS order_date FROM ({DATED})"))
def dates(spark, d):
    return parse_dates(_text_dates(spark, d), "order_date").select("o_orderkey", "order_date")


@query("excel_serial_dates", oracle(
    "SELECT event_id, date_trunc('second', ts) AS ts FROM events"))
def serial_dates(spark, d):
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    serial = F.datediff(F.col("ts").cast("date"), F.lit("1899-12-30").cast("date")) + seconds / 86400
    numbers = fx.table(spark, d, "events").select("event_id", serial.cast("double").alias("ts"))
    # Half a second on top: a serial keeps the time to about a microsecond.
    near = F.col("ts") + F.expr("interval '0.5' second")
    return parse_dates(numbers, "ts").select("event_id", F.date_trunc("second", near).cast("timestamp_ntz").alias("ts"))


@query("drop_bad_dates", oracle(f"""
    SELECT count(*) AS n, CAST(min(order_date) AS DATE) AS first_date, CAST(max(order_date) AS DATE) AS last_date
    FROM ({DATED}) WHERE order_date IS NOT NULL"""))
def drop_bad_dates(spark, d):
    spec = SalesSpec("order_date", "o_totalprice", order_by=("o_orderkey",))
    out = cleaning.prepare(_text_dates(spark, d), spec)
    return out.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("order_date").cast("date")).alias("first_date"),
                   F.max(F.col("order_date").cast("date")).alias("last_date"))


@query("coerce_numeric", oracle("""
    SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 1""", "total", 2))
def coerce(spark, d):
    text = F.when(F.col("o_orderkey") % 10 == 3, "unknown").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    return _by_status(cleaning.coerce_numeric(fx.table(spark, d, "orders").withColumn("o_totalprice", text), "o_totalprice"))


@query("drop_incomplete", oracle("""
    SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders
    WHERE o_orderkey % 4 <> 0 AND o_orderpriority <> '1-URGENT' GROUP BY 1""", "total", 2))
def incomplete(spark, d):
    holes = fx.table(spark, d, "orders").withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")),
        "o_orderpriority": F.nullif("o_orderpriority", F.lit("1-URGENT")),
    })
    return _by_status(cleaning.drop_incomplete(holes))


@query("calendar_features", oracle("""
    SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(month(o_orderdate) AS INTEGER) AS month,
      CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(dayofyear(o_orderdate) AS INTEGER) AS dayofyear,
      CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year,
      CAST(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS weekend,
      monthname(o_orderdate) AS month_name, dayname(o_orderdate) AS day_name FROM orders"""))
def calendar(spark, d):
    return calendar_features(fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("binary_flag", oracle("""
    SELECT product, CAST(sum(CASE WHEN holiday = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS holidays FROM sales GROUP BY 1"""))
def flag(spark, d):
    return cleaning.binary_flag(fx.sales(spark, d), "holiday").groupBy("product").agg(F.sum("holiday").alias("holidays"))


@query("one_hot", oracle("""
    SELECT product, count(*) FILTER (weather = 'Rain') AS weather_Rain, count(*) FILTER (weather = 'Sunny') AS weather_Sunny,
      count(*) FILTER (promo = 'Oui') AS promo_Oui FROM sales GROUP BY 1"""))
def dummies(spark, d):
    out = cleaning.one_hot(fx.sales(spark, d).select("product", "weather", "promo"), ["weather", "promo"])
    names = [c for c in out.columns if c != "product"]
    return out.groupBy("product").agg(*[F.count_if(c).alias(c) for c in names])


@query("one_hot_sparse", oracle("""
    WITH p AS (SELECT DISTINCT part_id AS v, dense_rank() OVER (ORDER BY part_id) - 1 AS i FROM sales),
    w AS (SELECT DISTINCT weather AS v, dense_rank() OVER (ORDER BY weather) - 1 AS i FROM sales),
    n AS (SELECT (SELECT count(*) FROM p) - 1 AS parts, (SELECT count(*) FROM p) + (SELECT count(*) FROM w) - 2 AS size)
    SELECT product, p.i AS part_id_index, w.i AS weather_index, CAST(size AS BIGINT) AS size,
           CASE WHEN p.i > 0 THEN CAST(p.i - 1 AS BIGINT) END AS part_place, CASE WHEN w.i > 0 THEN CAST(parts + w.i - 1 AS BIGINT) END AS weather_place,
           count(*) AS n
    FROM sales JOIN p ON p.v = part_id JOIN w ON w.v = weather CROSS JOIN n GROUP BY ALL"""))
def sparse_dummies(spark, d):
    """Parts and weather as one sparse vector: sizes and places."""
    out = cleaning.one_hot_sparse(fx.sales(spark, d).select("product", "part_id", "weather"), ["part_id", "weather"], rows_per_bucket=500)
    at, parts = F.col("features.positions"), F.col("part_id_index") > 0
    return out.groupBy(
        "product", "part_id_index", "weather_index", F.col("features.size").alias("size"),
        F.when(parts, at[0]).alias("part_place"), F.when(F.col("weather_index") > 0, F.element_at(at, -1)).alias("weather_place"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("valid_email", oracle(r"""
    SELECT contact_id, email, regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS ok FROM contacts"""))
def emails(spark, d):
    return fx.contacts(spark, d).select("contact_id", "email", valid_email("email").alias("ok"))


@query("valid_phone", oracle(r"""
    SELECT 'email' AS "check", count(*) FILTER (contact_id % 5 <> 0) AS valid, count(*) FILTER (contact_id % 5 = 0) AS invalid
    FROM contacts UNION ALL
    SELECT 'phone', count(*) FILTER (regexp_full_match(phone, '(\+212|0)[5-7]\d{8}')),
      count(*) FILTER (NOT regexp_full_match(phone, '(\+212|0)[5-7]\d{8}')) FROM contacts"""))
def phones(spark, d):
    return validity_counts(fx.contacts(spark, d), email=valid_email("email"), phone=valid_phone("phone"))


@query("time_index", oracle("""
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS time FROM orders"""))
def index(spark, d):
    return cleaning.time_index(fx.table(spark, d, "orders"), fx.ORDERS_SPEC).select("o_orderkey", "time")
