"""The supplied tables and the survey/panel shapes derived from them.

Each shape is one SQL text valid in Spark and DuckDB. ``{name}`` marks a supplied table.
The supplied tables hold no NULLs, so the shapes inject them by arithmetic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# shape -> (shapes it builds on, text)
_SHAPES: dict[str, tuple[tuple[str, ...], str]] = {
    "sv": ((), """
SELECT l_orderkey, l_linenumber, l_suppkey, c_nationkey, n_name AS cnt,
  CAST(year(o_orderdate) AS INT) AS year,
  CASE l_returnflag WHEN 'A' THEN 'Female' WHEN 'R' THEN 'Male' ELSE 'NA' END AS gender,
  CASE WHEN n_regionkey IN (2,3) THEN 'Yes' ELSE 'No' END AS oecd,
  l_quantity AS w,
  l_extendedprice/100 + ((l_orderkey*7 + l_linenumber*13 + 31) % 11) - 5 AS pv1,
  l_extendedprice/100 + ((l_orderkey*7 + l_linenumber*13 + 62) % 11) - 5 AS pv2,
  l_extendedprice/100 + ((l_orderkey*7 + l_linenumber*13 + 93) % 11) - 5 AS pv3,
  l_extendedprice/100 + ((l_orderkey*7 + l_linenumber*13 + 124) % 11) - 5 AS pv4,
  l_extendedprice/100 + ((l_orderkey*7 + l_linenumber*13 + 155) % 11) - 5 AS pv5,
  l_quantity * CASE WHEN l_orderkey % 2 = 0 THEN 15e-1 ELSE 5e-1 END AS rw1,
  l_quantity * CASE WHEN l_orderkey % 3 = 0 THEN 15e-1 ELSE 5e-1 END AS rw2,
  l_quantity * CASE WHEN l_suppkey % 2 = 0 THEN 15e-1 ELSE 5e-1 END AS rw3,
  l_quantity * CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 15e-1 ELSE 5e-1 END AS rw4
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
  JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""),
    "pn": ((), """
SELECT n_nationkey, n_name AS country, r_name AS region,
  CASE WHEN n_regionkey IN (2,3) THEN 'OECD' ELSE 'Non-OECD' END AS oecd,
  CAST(year(o_orderdate) AS INT) AS year, CAST(year(o_orderdate) - 1995 AS INT) AS time,
  count(*) AS n_total, count(DISTINCT c_custkey) AS pop,
  avg(o_totalprice)/1000 AS co2, avg(c_acctbal)/100 AS sl_total,
  sum(o_totalprice)/1000000 AS gdp,
  CASE WHEN (n_nationkey*7 + year(o_orderdate)*3) % 10 = 0 THEN NULL
       ELSE avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) END AS gini,
  CASE WHEN (n_nationkey + year(o_orderdate)) % 4 <> 0 THEN NULL
       ELSE avg(c_acctbal) END AS left_right,
  CASE WHEN n_nationkey = 3 THEN NULL ELSE min(c_acctbal) END AS democracy
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY n_nationkey, n_name, n_regionkey, r_name, year(o_orderdate)"""),
    "it": ((), """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 25 AS country,
  l_linenumber AS wave, CAST(year(l_shipdate) AS INT) AS year,
  CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 + CAST(floor(l_quantity/556e-2) AS INT) END AS f118,
  CASE WHEN l_partkey % 17 = 0 THEN -2
       ELSE 1 + CAST(floor((l_quantity + (l_orderkey*7) % 20)/77e-1) AS INT) END AS f120,
  CASE WHEN l_quantity + (l_partkey % 10) < 20 THEN 1 WHEN l_quantity + (l_partkey % 10) < 40 THEN 3 ELSE 2 END AS c001,
  1 + l_partkey % 10 AS e033, 1 + l_suppkey % 4 AS e143,
  CASE WHEN l_suppkey % 13 = 0 THEN -5 ELSE (l_orderkey + l_partkey) % 11 END AS e224
FROM {lineitem}"""),
    "pb": (("pn",), """
SELECT n_nationkey, country, region, oecd, year, time, sl_total, gdp,
  co2/10 + n_nationkey*2e0 + time*((n_nationkey*7) % 5)*15e-1 AS y
FROM pn WHERE year <= 2000"""),
    "wd": (("pn",), """
SELECT country, max(CASE WHEN year = 1995 THEN co2 END) AS x1995, max(CASE WHEN year = 1996 THEN co2 END) AS x1996,
  max(CASE WHEN year = 1997 THEN co2 END) AS x1997, max(CASE WHEN year = 1998 THEN co2 END) AS x1998,
  max(CASE WHEN year = 1999 THEN co2 END) AS x1999, max(CASE WHEN year = 2000 THEN co2 END) AS x2000,
  max(CASE WHEN year = 2001 THEN co2 END) AS x2001
FROM pn GROUP BY country"""),
    "mi": (("pn",), """
SELECT i.imp, p.n_nationkey, p.country, p.region, p.oecd, p.year, p.time, p.co2, ln(p.co2) AS co2_log, p.sl_total, p.gdp,
  coalesce(p.gini, 5e-1 + (((p.n_nationkey*7919 + p.year*104729 + i.imp*1299709) % 10007)/10007e0 - 5e-1)/10) AS gini
FROM pn p CROSS JOIN (SELECT DISTINCT p_size AS imp FROM {part} WHERE p_size BETWEEN 1 AND 20) i"""),
    # a codebook cell: every market segment with a running number and a span of years
    "cb": ((), """
SELECT 'seg' AS variable, string_agg(item, chr(10)) AS categories FROM (
  SELECT concat(CAST(row_number() OVER (ORDER BY c_mktsegment) AS VARCHAR(10)), '  ', c_mktsegment, '  ',
    CAST(min(year(o_orderdate)) AS VARCHAR(4)), '-', CAST(max(year(o_orderdate)) AS VARCHAR(4))) AS item
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment) s"""),
    "ev": ((), "SELECT event_id, ts, user_id, event_type, value FROM {events}"),
    "tx": ((), "SELECT doc_id, text, lang, source FROM {documents}"),
    "dim": ((), """
SELECT n_nationkey, n_name, r_regionkey, r_name
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""),
}


def shape_cte(*names: str) -> str:
    """``WITH a AS (…), b AS (…)`` over plainly named tables, for the DuckDB side."""
    plain = {t: t for t in TABLES}
    parts = [f"{n} AS ({_SHAPES[n][1].format(**plain)})" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n"


def _closure(names) -> list[str]:
    out: list[str] = []
    for name in names:
        for dep in (*_SHAPES[name][0], name):
            if dep not in out:
                out.append(dep)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazy DataFrame of one derived shape."""
    names = _closure((name,))
    text = "WITH " + ",\n".join(f"{n} AS ({_SHAPES[n][1]})" for n in names)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\{{{t}\}}", text)}
    return spark.sql(f"{text} SELECT * FROM {name}", **used)
