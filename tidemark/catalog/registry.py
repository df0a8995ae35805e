"""Registry of queries and helpers to write their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The fixture views as SQL, written independently of the DataFrame versions.
SALES = """
SELECT CAST(l.l_shipdate AS DATE) AS sale_date, l.l_orderkey AS order_id, l.l_linenumber AS line_no,
       l.l_partkey AS part_id, l.l_suppkey AS supp_id, p.p_type AS product, p.p_brand AS brand, r.r_name AS region,
       CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS amount, l.l_quantity AS quantity,
       p.p_retailprice AS unit_price, l.l_tax * 10000 AS marketing, l.l_quantity * 10 AS stock,
       CASE WHEN l.l_discount >= 0.05 THEN 'Oui' ELSE 'Non' END AS promo,
       CASE WHEN month(l.l_shipdate) = 12 AND day(l.l_shipdate) >= 24 THEN 'Yes' ELSE 'No' END AS holiday,
       CASE l.l_returnflag WHEN 'A' THEN 'Sunny' WHEN 'N' THEN 'Rain' ELSE 'Cloud' END AS weather
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
CONTACTS = """
SELECT c_custkey AS contact_id, c_name,
       CASE WHEN c_custkey % 5 = 0 THEN c_name
            ELSE concat('client', CAST(c_custkey AS VARCHAR), '@shop.ma') END AS email,
       CASE WHEN c_custkey % 7 = 0 THEN '12345'
            ELSE concat('+2126', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) END AS phone
FROM customer
"""
ORDER = "sale_date, order_id, line_no, part_id, supp_id"


def _shift(digits: int) -> float:
    """A small part of the last kept digit: means of few decimals often end exactly between two roundings,
    where the last bit of either engine would decide."""
    return 0.003 * 10.0**-digits


def rounded(df: DataFrame, digits: int = 4, **columns: int) -> DataFrame:
    """Round every double column, so that two engines' last bits do not count as a difference."""
    doubles = {f.name: columns.get(f.name, digits) for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.withColumns({c: F.round(F.col(c) + _shift(n), n) for c, n in doubles.items()})


def oracle(sql: str, doubles: str = "", digits: int = 4, **columns: int) -> str:
    """Wrap a query over ``sales`` and ``contacts`` and round its double columns the same way."""
    names = {c: columns.get(c, digits) for c in doubles.split()}
    replace = ", ".join(f"round({c} + CAST({_shift(n)!r} AS DOUBLE), {n}) + 0.0 AS {c}" for c, n in names.items())
    chosen = f"* REPLACE ({replace})" if names else "*"
    return f"WITH sales AS ({SALES}), contacts AS ({CONTACTS}) SELECT {chosen} FROM ({sql})"


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` with its check."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add
