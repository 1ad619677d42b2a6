"""Feature preparation and row validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import prepare as PR
from tessera.operators import validate as V
from tessera.operators.folds import kfold_assign
from tessera.operators.score import FeatureSpec, Manifest
from tessera.plans.catalog import query
from tessera.plans.fixtures import LINEITEM_NA_SQL, ORDERS_NA_SQL, lineitem_na, orders_na, table
from tessera.plans.q_folds import FOLD_SQL
from tessera.plans.q_profile import CUSTOMER_NA_SQL, customer_na
from tessera.plans.q_score import PRICE_MANIFEST


def _mode_sql(c, src="src"):
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _impute(spark, sf_dir, strategy, **kw):
    o = orders_na(spark, sf_dir)
    m = PR.fit_imputer(o, ["o_custkey", "o_totalprice"], [], numeric_strategy=strategy, **kw)
    return m.transform(o).select("o_orderkey", "o_custkey", "o_totalprice")


@query("impute_median", f"""
WITH src AS ({ORDERS_NA_SQL})
SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM src)) AS o_custkey,
       round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM src)), 6) AS o_totalprice FROM src""")
def q_impute_median(spark, sf_dir):
    return _impute(spark, sf_dir, "median").withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("impute_mean", f"""
WITH src AS ({ORDERS_NA_SQL})
SELECT o_orderkey, round(coalesce(CAST(o_custkey AS DOUBLE), (SELECT avg(o_custkey) FROM src)), 6) AS o_custkey,
       round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM src)), 4) AS o_totalprice FROM src""")
def q_impute_mean(spark, sf_dir):
    return _impute(spark, sf_dir, "mean").select("o_orderkey", F.round("o_custkey", 6).alias("o_custkey"),
                                                 F.round("o_totalprice", 4).alias("o_totalprice"))


@query("impute_mode", f"""
WITH src AS ({ORDERS_NA_SQL})
SELECT o_orderkey, CAST(coalesce(CAST(o_custkey AS DOUBLE), {_mode_sql('o_custkey')}) AS DOUBLE) AS o_custkey,
       coalesce(o_totalprice, {_mode_sql('o_totalprice')}) AS o_totalprice FROM src""")
def q_impute_mode(spark, sf_dir):
    return _impute(spark, sf_dir, "most_frequent")


@query("impute_constant", f"""
WITH src AS ({ORDERS_NA_SQL})
SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), -1.0) AS o_custkey, coalesce(o_totalprice, -1.0) AS o_totalprice
FROM src""")
def q_impute_constant(spark, sf_dir):
    return _impute(spark, sf_dir, "constant", numeric_constant=-1.0)


@query("impute_categorical", f"""
WITH src AS ({ORDERS_NA_SQL})
SELECT o_orderkey, coalesce(o_orderpriority, {_mode_sql('o_orderpriority')}) AS priority_most_frequent,
       coalesce(o_orderpriority, 'Missing') AS priority_constant FROM src""")
def q_impute_categorical(spark, sf_dir):
    o = orders_na(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    mf = PR.fit_imputer(o, [], ["o_orderpriority"], categorical_strategy="most_frequent")
    const = PR.fit_imputer(o, [], ["o_orderpriority"], categorical_strategy="constant")
    a = mf.transform(o).withColumnRenamed("o_orderpriority", "priority_most_frequent")
    b = const.transform(o).withColumnRenamed("o_orderpriority", "priority_constant")
    # both fills are projections of the same rows: join on the unique key
    return a.join(b, "o_orderkey")


@query("one_hot", f"""
WITH p AS (SELECT p_partkey, p_brand, CAST((row_number() OVER (ORDER BY md5('42|' || CAST(p_partkey AS VARCHAR)), p_partkey) - 1) % 5 AS INTEGER) AS fold FROM part),
cats AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT p_brand FROM p WHERE fold <> 0))
SELECT p.p_partkey, (SELECT CAST(count(*) AS INTEGER) FROM cats) AS width, cats.idx AS slot
FROM p LEFT JOIN cats ON cats.p_brand = p.p_brand""")
def q_one_hot(spark, sf_dir):
    p = kfold_assign(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"])
    return PR.one_hot_slot(p, "p_brand", PR.fit_one_hot(p.filter(F.col("fold") != 0), "p_brand")).select("p_partkey", "width", "slot")


@query("label_encode", """
WITH c AS (SELECT o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label_index
           FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT o.o_orderkey, o.o_orderstatus, c.label_index FROM orders o JOIN c ON c.o_orderstatus = o.o_orderstatus""")
def q_label_encode(spark, sf_dir):
    out, _ = PR.label_encode(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    return out


@query("impute_per_fold", f"""
WITH src AS (SELECT *, {FOLD_SQL} AS fold FROM ({ORDERS_NA_SQL})),
f AS (SELECT DISTINCT fold FROM src),
fit AS (SELECT f.fold,
               (SELECT quantile_cont(s.o_totalprice, 0.5) FROM src s WHERE s.fold <> f.fold) AS med,
               (SELECT avg(s.o_custkey) FROM src s WHERE s.fold <> f.fold) AS mu FROM f)
SELECT o_orderkey, src.fold, round(coalesce(CAST(o_custkey AS DOUBLE), fit.mu), 6) AS o_custkey,
       round(coalesce(o_totalprice, fit.med), 4) AS o_totalprice
FROM src JOIN fit ON fit.fold = src.fold""")
def q_impute_per_fold(spark, sf_dir):
    o = kfold_assign(orders_na(spark, sf_dir), ["o_orderkey"]).withColumn("o_custkey", F.col("o_custkey").cast("double"))
    out = PR.impute_per_fold(o, "fold", 5, median_cols=["o_totalprice"], mean_cols=["o_custkey"])
    return out.select("o_orderkey", "fold", F.round("o_custkey", 6).alias("o_custkey"),
                      F.round("o_totalprice", 4).alias("o_totalprice"))


@query("drop_null_target", f"SELECT o_orderkey, o_totalprice FROM ({ORDERS_NA_SQL}) WHERE o_totalprice IS NOT NULL")
def q_drop_null_target(spark, sf_dir):
    return V.drop_null_target(orders_na(spark, sf_dir), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("drop_null_features", f"""
SELECT o_orderkey, o_custkey, o_orderpriority FROM ({ORDERS_NA_SQL})
WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL""")
def q_drop_null_features(spark, sf_dir):
    # numeric_imputer = 'drop': the numeric block passes through after the row drop
    return V.drop_null_features(orders_na(spark, sf_dir), ["o_custkey", "o_orderpriority"]) \
        .select("o_orderkey", "o_custkey", "o_orderpriority")


@query("clean_required_rows", f"""
WITH src AS ({LINEITEM_NA_SQL})
SELECT count(*) AS rows_in,
       count_if(l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL) AS rows_kept,
       count(*) - count_if(l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL) AS dropped_rows
FROM src""")
def q_clean_required_rows(spark, sf_dir):
    _, stats = V.clean_required_rows(lineitem_na(spark, sf_dir), PRICE_MANIFEST, "l_extendedprice")
    return stats


# Scoring contract over the text customer table: balance as float, nation as int.
CUSTOMER_MANIFEST = Manifest(id="cust", name="cust", target="c_mktsegment",
                             features=(FeatureSpec("c_acctbal", "float64"), FeatureSpec("c_nationkey", "int64")))
_NUM_SQL = r"regexp_matches({c}, '^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$') OR regexp_matches({c}, '^\s*[+-]?(inf|Inf|INF|infinity|Infinity)\s*$')"


def _bad(c):
    return f"({c} IS NOT NULL AND NOT ({_NUM_SQL.format(c=c)}))"


@query("guard_counts", f"""
WITH src AS ({CUSTOMER_NA_SQL})
SELECT count(*) AS rows_in,
       count_if(c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL) AS rows_kept,
       count_if({_bad('c_acctbal')}) AS bad_c_acctbal, count_if({_bad('c_nationkey')}) AS bad_c_nationkey,
       count(*) - count_if(c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL) AS dropped_rows
FROM src""")
def q_guard_counts(spark, sf_dir):
    return V.guard_counts(customer_na(spark, sf_dir), CUSTOMER_MANIFEST, ground_truth="c_mktsegment")


@query("validate_numeric_coercion", f"""
WITH src AS ({CUSTOMER_NA_SQL})
SELECT 'c_acctbal' AS column_name, 'float64' AS dtype, count_if({_bad('c_acctbal')}) AS violations FROM src
UNION ALL
SELECT 'c_nationkey', 'int64', count_if({_bad('c_nationkey')}) FROM src""")
def q_validate_numeric_coercion(spark, sf_dir):
    g = V.guard_counts(customer_na(spark, sf_dir), CUSTOMER_MANIFEST)
    return g.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dtype).alias("dtype"), F.col(f"bad_{f.name}").alias("violations"))
        for f in CUSTOMER_MANIFEST.features])).alias("v")).select("v.*")


@query("cast_features", f"""
WITH src AS ({CUSTOMER_NA_SQL})
SELECT c_custkey, TRY_CAST(trim(c_acctbal) AS DOUBLE) AS c_acctbal,
       CAST(trunc(TRY_CAST(trim(c_nationkey) AS DOUBLE)) AS BIGINT) AS c_nationkey,
       CAST(trunc(TRY_CAST(trim(c_acctbal) AS DOUBLE)) AS BIGINT) AS acctbal_int
FROM src""")
def q_cast_features(spark, sf_dir):
    c = customer_na(spark, sf_dir).withColumn("acctbal_int", F.col("c_acctbal"))
    man = Manifest(id="cast", name="cast", features=CUSTOMER_MANIFEST.features + (FeatureSpec("acctbal_int", "int64"),))
    return V.cast_features(c, man).select("c_custkey", "c_acctbal", "c_nationkey", "acctbal_int")


@query("training_guards", f"""
WITH src AS (SELECT * FROM ({ORDERS_NA_SQL}) WHERE o_orderpriority IS NOT NULL),
c AS (SELECT o_orderpriority, count(*) AS n FROM src GROUP BY 1)
SELECT sum(n) AS usable_rows, count(*) AS n_classes, min(n) AS min_class_count,
       sum(n) >= 5 AND count(*) >= 2 AND min(n) >= 5 AS ok FROM c""")
def q_training_guards(spark, sf_dir):
    o = V.drop_null_target(orders_na(spark, sf_dir), "o_orderpriority")
    return V.training_guards(o, "o_orderpriority", folds=5, classification=True)
