"""Inputs for the named queries, derived from the given tables by projection only.

Every fixture reads whole tables; missing values are *injected* by a key rule (no row
is filtered away), because the given tables carry no nulls. Each Spark derivation has
a SQL twin (a CTE body) used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_when(cond, c):
    return F.when(cond, F.lit(None)).otherwise(c)


# ------------------------------------------------------------------ lineitem with gaps
# Fixed rule (both engines): l_quantity missing when l_orderkey % 17 = 0,
# l_discount when % 37 = 0, l_tax when % 29 = 0, l_returnflag when % 31 = 0.

def lineitem_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        _null_when(k % 17 == 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        _null_when(k % 37 == 0, F.col("l_discount")).alias("l_discount"),
        _null_when(k % 29 == 0, F.col("l_tax")).alias("l_tax"),
        _null_when(k % 31 == 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate",
    )


LINEITEM_NA_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice,
       CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE l_discount END AS l_discount,
       CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE l_tax END AS l_tax,
       CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
       l_linestatus, l_shipdate
FROM lineitem"""


# ------------------------------------------------------------------ orders with gaps
# o_totalprice missing when o_orderkey % 13 = 0; o_orderpriority when % 19 = 0;
# o_custkey when % 23 = 0.

def orders_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        _null_when(k % 23 == 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        _null_when(k % 13 == 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        _null_when(k % 19 == 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


ORDERS_NA_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       o_orderstatus,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders"""


# ------------------------------------------------------------------ customer as text
# The customer table as a text file would arrive: every cell a string, with NA tokens
# and blanks injected by key rule (c_acctbal 'NA' when key % 11 = 0, c_mktsegment ''
# when % 7 = 0, c_nationkey ' ' (blank, not NA) when % 13 = 0, c_name 'null' when % 17 = 0).

def customer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(k % 17 == 0, F.lit("null")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 13 == 0, F.lit(" ")).otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.when(k % 11 == 0, F.lit("NA")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )


CUSTOMER_TEXT_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
       CASE WHEN c_custkey % 17 = 0 THEN 'null' ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
       CASE WHEN c_custkey % 11 = 0 THEN 'NA' ELSE CAST(c_acctbal AS VARCHAR) END AS c_acctbal,
       CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment
FROM customer"""


# ------------------------------------------------------------------ events as lifecycle log
# event_type read as a job lifecycle state (fixed mapping):
#   signup -> queued, view -> running, purchase -> completed, error -> failed,
#   click  -> (log noise, not a state)
LIFECYCLE = {"signup": "queued", "view": "running", "purchase": "completed", "error": "failed"}


def lifecycle_state(c):
    e = None
    for k, v in LIFECYCLE.items():
        e = (F.when(c == k, F.lit(v)) if e is None else e.when(c == k, F.lit(v)))
    return e


LIFECYCLE_SQL = ("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' "
                 "WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END")
