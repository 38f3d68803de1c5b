"""Panel views of the test tables: one SQL text for Spark and for the oracle.

Suppliers stand for firms. Values are rounded, so that every engine starts from the same doubles;
missing values, zero denominators and missing years come by modular rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRM_YEAR = """
SELECT l_suppkey AS permno, year(l_shipdate) AS year, year(l_shipdate) + 1 AS form_year,
       CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE (max(s_nationkey) * 4 + 1) * 100 END AS sic,
       CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE substring(lpad(CAST((max(s_nationkey) * 4 + 1) * 100 AS VARCHAR(10)), 4, '0'), 1, 2) END AS sic2,
       round(sum(l_extendedprice), 2) AS `at`,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revt,
       round(sum(l_extendedprice * (1 - l_discount)) * 0.6 + sum(l_quantity) * 10, 2) AS cogs,
       round(sum(l_extendedprice * (l_discount - l_tax)), 2) AS ib,
       CASE WHEN (l_suppkey + year(l_shipdate)) % 5 = 0 THEN NULL ELSE round(sum(l_tax * l_quantity), 4) END AS xrd,
       round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS dltt,
       CASE WHEN (l_suppkey + year(l_shipdate)) % 7 = 0 THEN 0.0 ELSE round(sum(l_quantity), 2) END AS che
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
WHERE (l_suppkey + year(l_shipdate)) % 11 <> 0
GROUP BY l_suppkey, year(l_shipdate)
"""

STOCK_MONTH = """
SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS month_end,
       year(l_shipdate) * 12 + month(l_shipdate) AS month_idx,
       CASE WHEN month(l_shipdate) >= 7 THEN year(l_shipdate) ELSE year(l_shipdate) - 1 END AS form_year,
       round(avg(l_discount) - avg(l_tax), 8) AS ret,
       CASE WHEN (l_suppkey + year(l_shipdate) * 12 + month(l_shipdate)) % 29 = 0 THEN NULL ELSE round(sum(l_extendedprice), 2) END AS me,
       max(s_nationkey) % 2 = 0 AS nyse,
       (max(s_nationkey) * 4 + 1) * 100 AS siccd
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE)), year(l_shipdate), month(l_shipdate)
"""

FACTOR_MONTH = """
SELECT month_idx, month_end, round(avg(ret), 8) AS mktrf,
       round(avg(CASE WHEN siccd % 800 = 100 THEN ret END) - avg(CASE WHEN siccd % 800 <> 100 THEN ret END), 8) AS smb,
       round(avg(CASE WHEN nyse THEN ret END) - avg(CASE WHEN NOT nyse THEN ret END), 8) AS hml,
       0.003 AS rf
FROM {fx_stock_month} GROUP BY month_idx, month_end
"""

LINK = """
SELECT s_suppkey AS gvkey, s_suppkey AS permno, CAST('1995-01-01' AS DATE) AS linkdt,
       CASE WHEN s_suppkey % 4 = 0 THEN CAST('1998-06-30' AS DATE) END AS linkenddt,
       CASE WHEN s_suppkey % 9 = 0 THEN 'XX' ELSE 'LC' END AS linktype, 'P' AS linkprim
FROM {supplier}
UNION ALL
SELECT s_suppkey, s_suppkey + 100000, CAST('1998-07-01' AS DATE), CAST(NULL AS DATE), 'LU', 'C' FROM {supplier} WHERE s_suppkey % 4 = 0
"""

EVALUATED = """
SELECT event_id AS signal_no, concat('run', CAST(user_id % 3 AS VARCHAR(10))) AS run,
       concat('pair', CAST(user_id % 28 AS VARCHAR(10))) AS pair, CAST(day(ts) % 10 AS INT) AS generation,
       CASE WHEN event_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS expected_sign,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE round(ln(value + 1) - 2.5, 6) END AS fmb_tstat,
       CASE WHEN event_id % 97 = 0 THEN 'boom' END AS error, event_type AS mechanism
FROM {events}
"""

VIEWS = {"fx_firm_year": FIRM_YEAR, "fx_stock_month": STOCK_MONTH, "fx_factor_month": FACTOR_MONTH, "fx_link": LINK, "fx_evaluated": EVALUATED}
TABLES = ("lineitem", "supplier", "events", "orders", "customer", "part", "nation", "region", "documents", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a table, over the parquet files of sf_dir."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in (*TABLES, *VIEWS) if f"{{{n}}}" in text}
    return spark.sql(text, **inputs)


def oracle_view(name: str) -> str:
    """The view's text for the oracle, which has the tables by their names."""
    text = VIEWS[name].replace("`at`", '"at"')
    return text.format(**{n: n for n in (*TABLES, *VIEWS)})


def with_views(query: str) -> str:
    """An oracle query with the views that it names in front of it."""
    used = {n for n in VIEWS if n in query}
    if "fx_factor_month" in used:
        used.add("fx_stock_month")
    head = ", ".join(f"{n} AS MATERIALIZED ({oracle_view(n)})" for n in VIEWS if n in used)
    query = query.strip()
    if query.upper().startswith("WITH "):
        return f"WITH {head}, {query[5:]}" if head else query
    return f"WITH {head} {query}" if head else query
