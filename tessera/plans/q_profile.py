"""Profiling queries (P1-P19) over whole tables with injected gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import NA_TOKENS, na_token_to_null
from tessera.operators import profile as P
from tessera.plans.catalog import query
from tessera.plans.fixtures import (CUSTOMER_TEXT_SQL, LINEITEM_NA_SQL, ORDERS_NA_SQL, customer_text,
                                    lineitem_na, orders_na)

# Column lists of the fixtures (name, Spark type) -- the SQL twins are generated from them.
LINEITEM_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")]
ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")]
NUMERIC = ("bigint", "int", "double")
R = 6


def _r(c):
    return F.round(F.col(c), R).alias(c)


def _rounded(df):
    return df.select(*[_r(c) if c in ("minimum", "maximum", "mean", "std", "median", "q1", "q3") else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------------ SQL generators

def _col_sql(i, name, typ, fields):
    num = typ in NUMERIC
    x = f"CAST({name} AS DOUBLE)"
    parts = {
        "position": f"{i} AS position",
        "name": f"'{name}' AS name",
        "raw_dtype": f"'{typ}' AS raw_dtype",
        "ml_type": f"'{'numeric' if num else 'categorical'}' AS ml_type",
        "missing_count": f"CAST(count(*) - count({name}) AS BIGINT) AS missing_count",
        "missing_rate": f"round((count(*) - count({name})) / greatest(count(*), 1), 4) AS missing_rate",
        "unique_count": f"CAST(count(DISTINCT {name}) AS BIGINT) AS unique_count",
        "mode": (f"(SELECT CAST({name} AS VARCHAR) FROM src WHERE {name} IS NOT NULL GROUP BY {name} "
                 f"ORDER BY count(*) DESC, {name} ASC LIMIT 1) AS mode"),
        "minimum": f"round(min({x}), {R}) AS minimum" if num else "CAST(NULL AS DOUBLE) AS minimum",
        "maximum": f"round(max({x}), {R}) AS maximum" if num else "CAST(NULL AS DOUBLE) AS maximum",
        "mean": f"round(avg({x}), {R}) AS mean" if num else "CAST(NULL AS DOUBLE) AS mean",
        "std": (f"round(CASE count({name}) WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE stddev_samp({x}) END, {R}) AS std"
                if num else "CAST(NULL AS DOUBLE) AS std"),
        "median": f"round(quantile_cont({x}, 0.5), {R}) AS median" if num else "CAST(NULL AS DOUBLE) AS median",
        "q1": f"round(quantile_cont({x}, 0.25), {R}) AS q1",
        "q3": f"round(quantile_cont({x}, 0.75), {R}) AS q3",
        "outlier_count": (
            f"(SELECT CAST(CASE WHEN max(f.q3) - max(f.q1) = 0 OR max(f.q1) IS NULL THEN 0 ELSE "
            f"count_if({x} < f.q1 - 1.5 * (f.q3 - f.q1) OR {x} > f.q3 + 1.5 * (f.q3 - f.q1)) END AS BIGINT) "
            f"FROM src, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM src) f) "
            f"AS outlier_count" if num else "CAST(NULL AS BIGINT) AS outlier_count"),
    }
    scalar_only = set(fields) <= {"position", "name", "raw_dtype", "ml_type", "mode", "outlier_count"}
    return "SELECT " + ", ".join(parts[f] for f in fields) + (" FROM (SELECT 1) one" if scalar_only else " FROM src")


def profile_sql(src_sql, cols, fields, numeric_only=False):
    body = "\nUNION ALL\n".join(_col_sql(i, n, t, fields) for i, (n, t) in enumerate(cols)
                                 if not numeric_only or t in NUMERIC)
    return f"WITH src AS ({src_sql})\n{body}"


FULL = ["position", "name", "raw_dtype", "ml_type", "missing_count", "missing_rate", "unique_count",
        "outlier_count", "minimum", "maximum", "mean", "std", "median", "mode"]


# ------------------------------------------------------------------ queries

@query("profile_table", profile_sql(LINEITEM_NA_SQL, LINEITEM_COLS, FULL))
def q_profile_table(spark, sf_dir):
    return _rounded(P.profile(lineitem_na(spark, sf_dir)))


@query("profile_shape", f"""
WITH src AS ({ORDERS_NA_SQL}) SELECT count(*) AS row_count, {len(ORDERS_COLS)} AS column_count FROM src""")
def q_profile_shape(spark, sf_dir):
    return P.shape(orders_na(spark, sf_dir))


@query("profile_missing", profile_sql(ORDERS_NA_SQL, ORDERS_COLS, ["position", "name", "missing_count", "missing_rate"]))
def q_profile_missing(spark, sf_dir):
    s = P.column_stats(orders_na(spark, sf_dir), quartiles=False, moments=False)
    return s.select("position", "name", "missing_count",
                    F.round(F.col("missing_count") / F.greatest(F.col("n"), F.lit(1)), 4).alias("missing_rate"))


@query("profile_unique", profile_sql(ORDERS_NA_SQL, ORDERS_COLS, ["position", "unique_count"]))
def q_profile_unique(spark, sf_dir):
    return P.value_stats(orders_na(spark, sf_dir)).select(F.col("pos").alias("position"), "unique_count")


@query("profile_mode", profile_sql(LINEITEM_NA_SQL, LINEITEM_COLS, ["position", "mode"]))
def q_profile_mode(spark, sf_dir):
    return P.value_stats(lineitem_na(spark, sf_dir)).select(F.col("pos").alias("position"), "mode")


@query("profile_numeric", profile_sql(ORDERS_NA_SQL, ORDERS_COLS,
                                     ["position", "name", "minimum", "maximum", "mean", "std"], numeric_only=True))
def q_profile_numeric(spark, sf_dir):
    s = P.column_stats(orders_na(spark, sf_dir), quartiles=False).filter(F.col("ml_type") == "numeric")
    return _rounded(s.select("position", "name", "minimum", "maximum", "mean", "std"))


@query("profile_quantiles", profile_sql(LINEITEM_NA_SQL, LINEITEM_COLS, ["position", "q1", "median", "q3"],
                                        numeric_only=True))
def q_profile_quantiles(spark, sf_dir):
    s = P.column_stats(lineitem_na(spark, sf_dir), moments=False).filter(F.col("ml_type") == "numeric")
    return _rounded(s.select("position", "q1", "median", "q3"))


@query("profile_outliers", profile_sql(LINEITEM_NA_SQL, LINEITEM_COLS, ["position", "outlier_count"],
                                       numeric_only=True))
def q_profile_outliers(spark, sf_dir):
    df = lineitem_na(spark, sf_dir)
    return P.outlier_stats(df, P.column_stats(df, moments=False))


# ------------------------------------------------------------------ text tables

def _na_sql(c):
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
    return f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END AS {c}"


CUSTOMER_TEXT_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_NA_SQL = f"SELECT {', '.join(_na_sql(c) for c in CUSTOMER_TEXT_COLS)} FROM ({CUSTOMER_TEXT_SQL})"


def customer_na(spark, sf_dir):
    t = customer_text(spark, sf_dir)
    return t.select(*[na_token_to_null(F.col(c)).alias(c) for c in t.columns])


def _infer_sql():
    from tessera.functions.columns import FALSE_TOKENS, FLOAT_PATTERN, INF_PATTERN, INT_PATTERN, TRUE_TOKENS
    bools = ", ".join(f"'{t}'" for t in TRUE_TOKENS + FALSE_TOKENS)
    parts = []
    for i, c in enumerate(CUSTOMER_TEXT_COLS):
        n = f"count({c})"
        parts.append(f"""SELECT {i} AS position, '{c}' AS name,
  CASE WHEN {n} = 0 THEN 'double'
       WHEN count_if(regexp_matches({c}, '{INT_PATTERN}') AND try_cast(trim({c}) AS BIGINT) IS NOT NULL) = {n} THEN 'bigint'
       WHEN count_if(regexp_matches({c}, '{INT_PATTERN}')) = {n} THEN 'string'
       WHEN count_if(regexp_matches({c}, '{FLOAT_PATTERN}') OR regexp_matches({c}, '{INF_PATTERN}')) = {n} THEN 'double'
       WHEN count_if({c} IN ({bools})) = {n} THEN 'boolean' ELSE 'string' END AS raw_dtype FROM src""")
    body = "\nUNION ALL\n".join(parts)
    return (f"WITH src AS ({CUSTOMER_NA_SQL}), t AS ({body})\n"
            "SELECT *, CASE WHEN raw_dtype IN ('bigint', 'double') THEN 'numeric' ELSE 'categorical' END AS ml_type FROM t")


@query("infer_types", _infer_sql())
def q_infer_types(spark, sf_dir):
    return P.infer_types(customer_na(spark, sf_dir))


@query("file_stats", f"""
WITH src AS ({CUSTOMER_TEXT_SQL}),
b AS (SELECT {' AND '.join(f"coalesce(trim({c}), '') = ''" for c in CUSTOMER_TEXT_COLS)} AS all_blank,
             {' OR '.join(f"coalesce(trim({c}), '') = ''" for c in CUSTOMER_TEXT_COLS)} AS any_blank FROM src)
SELECT count_if(NOT all_blank) AS total_rows, count_if(NOT all_blank AND any_blank) AS rows_with_blank,
       count_if(NOT all_blank) - count_if(NOT all_blank AND any_blank) AS predictable_rows FROM b""")
def q_file_stats(spark, sf_dir):
    return P.file_stats(customer_text(spark, sf_dir))


@query("preview_head", f"""
WITH src AS ({CUSTOMER_TEXT_SQL}),
nb AS (SELECT * FROM src WHERE NOT ({' AND '.join(f"coalesce(trim({c}), '') = ''" for c in CUSTOMER_TEXT_COLS)}))
SELECT *, (SELECT count(*) FROM nb) AS total_rows FROM nb ORDER BY c_custkey LIMIT 10""")
def q_preview_head(spark, sf_dir):
    return P.preview(customer_text(spark, sf_dir), ["c_custkey"], 10)


@query("target_candidates", f"""
WITH src AS ({ORDERS_NA_SQL}),
cols AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', '{'numeric' if t in NUMERIC else 'categorical'}')" for i, (n, t) in enumerate(ORDERS_COLS))}) v(position, name, ml_type))
SELECT position, name, ml_type, ml_type = 'numeric' AS regression_candidate, TRUE AS classification_candidate,
       name <> 'o_totalprice' AS feature_when_target_is_price,
       (SELECT count(*) FROM src) AS row_count
FROM cols""")
def q_target_candidates(spark, sf_dir):
    """Target candidates per problem type from the profile's ml_type, and the
    feature list once 'o_totalprice' is chosen as target."""
    s = P.column_stats(orders_na(spark, sf_dir), quartiles=False, moments=False)
    return P.feature_choices(s, "o_totalprice").withColumnsRenamed({"feature": "feature_when_target_is_price", "n": "row_count"})
