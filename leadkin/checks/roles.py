"""The driver's tables in the roles of companies, contacts and pages.

A template in braces runs on both engines: Spark gets the tables as DataFrames,
DuckDB gets their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadkin import fixed

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def check(sql: str | None = None):
    """Register a query under the name of its function, with its SQL if there is one."""

    def add(query: Query) -> Query:
        REGISTRY[query.__name__] = (query, sql)
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", template))
    return spark.sql(template, **{n: table(spark, sf_dir, n) for n in names})


def duck(template: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", template)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


HEADERS = {
    "id": fixed.ROW_ORD, "name": fixed.NAME, "cust_no": fixed.CUST_NO, "profile": fixed.PROFILE,
    "w1": fixed.WELFARE, "w2": fixed.WELFARE_TAGS, "w3": fixed.LEGAL_TAGS, "w4": fixed.SIGNAL_WORDS,
    "city": fixed.CITY, "district": fixed.DISTRICT, "employees": fixed.EMPLOYEES, "capital": fixed.CAPITAL,
    "industry": fixed.INDUSTRY, "signal": fixed.SIGNAL, **{f"f{i}": c for i, c in enumerate(fixed.INDUSTRY_FLAGS)},
}


def companies(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    df = run(spark, sf_dir, template)
    return df.withColumnsRenamed({k: v for k, v in HEADERS.items() if k in df.columns})


def _flags(key: str) -> str:
    return ", ".join(f"CASE WHEN {key} % {i + 2} = 0 THEN 1 ELSE 0 END AS f{i}" for i in range(10))


POTENTIALS = f"""
SELECT c.c_custkey AS id, concat('Firm ', CAST(c.c_custkey AS STRING), ' 有限公司') AS name,
  concat('N', CAST(c.c_custkey AS STRING)) AS cust_no,
  concat(lower(c.c_mktsegment), ' of ', n.n_name) AS profile,
  concat('plan ', CAST(c.c_custkey % 13 AS STRING), ' ', lower(c.c_mktsegment)) AS w1,
  concat('t', CAST(c.c_custkey % 7 AS STRING)) AS w2, '' AS w3,
  CASE WHEN c.c_custkey % 4 = 0 THEN 'coffee' ELSE '' END AS w4,
  r.r_name AS city, n.n_name AS district, c.c_acctbal AS employees,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE c.c_custkey * 1000.0e0 END AS capital,
  lower(c.c_mktsegment) AS industry, {_flags('c.c_custkey')},
  CASE WHEN c.c_acctbal > 5000 THEN 'Y' ELSE 'no' END AS signal
FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey"""

CUSTOMERS = f"""
SELECT s.s_suppkey AS id, concat('FIRM', CAST(s.s_suppkey * 7 AS STRING), ' (north) 股份有限公司') AS name,
  concat('N', CAST(s.s_suppkey * 11 AS STRING)) AS cust_no,
  concat(CASE s.s_suppkey % 3 WHEN 0 THEN 'household goods' WHEN 1 THEN 'machinery' ELSE 'buildings' END, ' of ', n.n_name) AS profile,
  concat('plan ', CAST(s.s_suppkey % 13 AS STRING), ' automobile') AS w1,
  concat('t', CAST(s.s_suppkey % 7 AS STRING)) AS w2, 'leave' AS w3,
  CASE WHEN s.s_suppkey % 3 = 0 THEN 'coffee' ELSE '' END AS w4,
  r.r_name AS city, n.n_name AS district, s.s_acctbal AS employees,
  CASE WHEN s.s_suppkey % 8 = 0 THEN NULL ELSE s.s_suppkey * 9000.0e0 END AS capital,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'household' WHEN 1 THEN 'machinery' ELSE 'building' END AS industry, {_flags('s.s_suppkey')},
  CASE WHEN s.s_acctbal > 5000 THEN '是' ELSE '' END AS signal
FROM {{supplier}} s JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey"""

# Sizes alone, one of the two numbers often absent.
SIZE_POTENTIALS = """
SELECT c_custkey AS id, concat('p', CAST(c_custkey AS STRING)) AS name, c_acctbal AS employees,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal * 2 + 17 END AS capital FROM {customer}"""
SIZE_CUSTOMERS = """
SELECT s_suppkey AS id, concat('c', CAST(s_suppkey AS STRING)) AS name, s_acctbal AS employees,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal * 3 END AS capital FROM {supplier}"""

GEO_POTENTIALS = """
SELECT c.c_custkey AS id, concat('p', CAST(c.c_custkey AS STRING)) AS name,
  CASE WHEN c.c_custkey % 6 = 0 THEN '' ELSE CAST(n.n_regionkey AS STRING) END AS city,
  CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE CAST(n.n_nationkey AS STRING) END AS district
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey"""
GEO_CUSTOMERS = """
SELECT s.s_suppkey AS id, concat('c', CAST(s.s_suppkey AS STRING)) AS name, CAST(n.n_regionkey AS STRING) AS city,
  CASE WHEN s.s_suppkey % 5 = 0 THEN '' ELSE CAST(n.n_nationkey AS STRING) END AS district
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey"""

SIGNAL_POTENTIALS = """
SELECT c_custkey AS id, concat('p', CAST(c_custkey AS STRING)) AS name,
  CASE WHEN c_acctbal > 5000 THEN 'True' WHEN c_acctbal > 2500 THEN '1.0' ELSE '' END AS signal FROM {customer}"""
SIGNAL_CUSTOMERS = """
SELECT s_suppkey AS id, concat('c', CAST(s_suppkey AS STRING)) AS name,
  CASE WHEN s_acctbal > 9000 THEN 'yes' ELSE 'f' END AS signal FROM {supplier}"""


def _sizes_bought(key: str, source: str) -> str:
    flags = ", ".join(f"max(CASE WHEN p.p_size % 10 = {i} AND l.l_quantity >= 45 THEN 1 ELSE 0 END) AS f{i}" for i in range(10))
    return f"SELECT {key} AS id, concat('{key[0]}', CAST({key} AS STRING)) AS name, {flags} FROM {source} GROUP BY {key}"


JACCARD_POTENTIALS = _sizes_bought(
    "o.o_custkey", "{lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {orders} o ON l.l_orderkey = o.o_orderkey"
)
JACCARD_CUSTOMERS = _sizes_bought("l.l_suppkey", "{lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey")
