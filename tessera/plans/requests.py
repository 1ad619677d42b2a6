"""Request, manifest and column-catalogue tables derived from the given tables.

One training request (and one scoring request) per ``part`` row, so the audits grow
with the data. Every field comes from a fixed rule over the part key, and a share of
the requests is made invalid on purpose. The column catalogue lists the columns of
four datasets (lineitem, orders, customer, part) read from their schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.profile import ml_type, raw_dtype
from tessera.operators.contract import ALGORITHMS, ALLOWED_PARAMS  # noqa: F401
from tessera.plans.fixtures import table

DATASETS = ("lineitem", "orders", "customer", "part")

# Rule tables for generated requests (our own choices).
GEN_NUMERIC_IMPUTERS = ("median", "mean", "most_frequent", "constant", "drop", "zero")
GEN_CATEGORICAL_IMPUTERS = ("most_frequent", "constant", "mode")
GEN_HP_KEYS = (("max_depth", "n_estimators"), ("penalty", "C"), ("learning_rate", "gamma"), ("loss",),
               ("penalty", "solver"), ())
GEN_HP_VALUES = (("6", "100"), ("L1", "1.0"), ("0.1", "0.05"), ("square",), ("L1", "LBFGS"), ())

# Column lists of the four datasets, in schema order (must match the parquet schemas).
CATALOGUE = {
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
}


def column_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, position, column_name, dtype, ml_type) read from the table schemas
    (metadata only; no data is scanned)."""
    rows = []
    for ds in DATASETS:
        for i, f in enumerate(table(spark, sf_dir, ds).schema.fields):
            rows.append((ds, i, f.name, raw_dtype(f.dataType), ml_type(f.dataType)))
    return spark.createDataFrame(rows, "dataset_id string, position int, column_name string, dtype string, "
                                       "ml_type string")


def _str_array(xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def _pick(options, idx):
    return F.element_at(F.array(*[F.lit(o) for o in options]), idx + 1)


def training_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    ds_idx = (k % 4).cast("int")
    cols = F.element_at(F.array(*[_str_array([c for c, _ in CATALOGUE[d]]) for d in DATASETS]), ds_idx + 1)
    n = F.size(cols)
    feats = F.slice(cols, (size % n).cast("int") + 1, (k % 3).cast("int") + 1)
    feats = F.when(k % 13 == 0, F.concat(feats, F.array(F.lit("ghost_feature")))).otherwise(feats)
    target = F.when(k % 11 == 0, F.lit("no_such_column")).otherwise(F.element_at(cols, ((k % 7) % n).cast("int") + 1))
    hp_i = (k % 6).cast("int") + 1
    hp_keys = F.element_at(F.array(*[_str_array(x) for x in GEN_HP_KEYS]), hp_i)
    hp_vals = F.element_at(F.array(*[_str_array(x) for x in GEN_HP_VALUES]), hp_i)
    return p.select(
        k.alias("request_id"),
        _pick(DATASETS, ds_idx).alias("dataset_id"),
        F.when(k % 17 == 0, F.lit("x")).otherwise(F.col("p_name")).alias("model_name"),
        target.alias("target_column"),
        feats.alias("feature_columns"),
        F.when(k % 31 == 0, F.lit("ranking")).when(k % 2 == 0, F.lit("regression")).otherwise(F.lit("classification")).alias("problem_type"),
        F.when(k % 29 == 0, F.lit("linear_svm")).otherwise(_pick(ALGORITHMS, (k % 9).cast("int"))).alias("algorithm"),
        F.when(k % 3 == 0, _pick(DATASETS, ((k + F.when(k % 2 == 0, 1).otherwise(0)) % 4).cast("int"))).alias("test_dataset_id"),
        _pick(GEN_NUMERIC_IMPUTERS, (size % 6).cast("int")).alias("numeric_imputer"),
        _pick(GEN_CATEGORICAL_IMPUTERS, (k % 3).cast("int")).alias("categorical_imputer"),
        (size % 12).cast("int").alias("cv_folds"),
        F.when(k % 5 == 0, F.lit("truncated_svd")).otherwise(F.lit("none")).alias("dimension_reduction"),
        ((size * 3) % 120).cast("int").alias("svd_components"),
        F.map_from_arrays(hp_keys, hp_vals).alias("hyperparameters"),
    )


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]" if xs else "CAST([] AS VARCHAR[])"


def _sql_pick(options, idx):
    return f"{_sql_list(options)}[{idx} + 1]"


_COLS_SQL = "[" + ", ".join(_sql_list([c for c, _ in CATALOGUE[d]]) for d in DATASETS) + "]"

TRAINING_REQUESTS_SQL = f"""
SELECT p_partkey AS request_id,
       {_sql_pick(DATASETS, 'p_partkey % 4')} AS dataset_id,
       CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE p_name END AS model_name,
       CASE WHEN p_partkey % 11 = 0 THEN 'no_such_column'
            ELSE {_COLS_SQL}[p_partkey % 4 + 1][(p_partkey % 7) % len({_COLS_SQL}[p_partkey % 4 + 1]) + 1] END
         AS target_column,
       CASE WHEN p_partkey % 13 = 0
            THEN list_concat(list_slice({_COLS_SQL}[p_partkey % 4 + 1], p_size % len({_COLS_SQL}[p_partkey % 4 + 1]) + 1,
                                        p_size % len({_COLS_SQL}[p_partkey % 4 + 1]) + 1 + p_partkey % 3), ['ghost_feature'])
            ELSE list_slice({_COLS_SQL}[p_partkey % 4 + 1], p_size % len({_COLS_SQL}[p_partkey % 4 + 1]) + 1,
                            p_size % len({_COLS_SQL}[p_partkey % 4 + 1]) + 1 + p_partkey % 3) END AS feature_columns,
       CASE WHEN p_partkey % 31 = 0 THEN 'ranking' WHEN p_partkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS problem_type,
       CASE WHEN p_partkey % 29 = 0 THEN 'linear_svm' ELSE {_sql_pick(ALGORITHMS, 'p_partkey % 9')} END AS algorithm,
       CASE WHEN p_partkey % 3 = 0 THEN {_sql_pick(DATASETS, '(p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) % 4')} END AS test_dataset_id,
       {_sql_pick(GEN_NUMERIC_IMPUTERS, 'p_size % 6')} AS numeric_imputer,
       {_sql_pick(GEN_CATEGORICAL_IMPUTERS, 'p_partkey % 3')} AS categorical_imputer,
       CAST(p_size % 12 AS INTEGER) AS cv_folds,
       CASE WHEN p_partkey % 5 = 0 THEN 'truncated_svd' ELSE 'none' END AS dimension_reduction,
       CAST((p_size * 3) % 120 AS INTEGER) AS svd_components,
       [{', '.join(_sql_list(x) for x in GEN_HP_KEYS)}][p_partkey % 6 + 1] AS hp_keys,
       [{', '.join(_sql_list(x) for x in GEN_HP_VALUES)}][p_partkey % 6 + 1] AS hp_values
FROM part"""

CATALOGUE_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{d}', {i}, '{c}', '{t}', '{'numeric' if t in ('bigint', 'int', 'double') else 'categorical'}')"
    for d in DATASETS for i, (c, t) in enumerate(CATALOGUE[d])) + \
    ") v(dataset_id, position, column_name, dtype, ml_type)"

ALLOWED_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{p}')" for a, ps in ALLOWED_PARAMS.items() for p in ps) + ") v(algorithm, param)"


def allowed_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, p) for a, ps in ALLOWED_PARAMS.items() for p in ps],
                                 "algorithm string, param string")


# ------------------------------------------------------------------ scoring requests
# One per part row: the model contract is the training request's (features, target),
# the scored dataset is the request's dataset, and the ground-truth argument is
#   key % 4 = 0 -> not given (auto), 1 -> '' (off), 2 -> the target, 3 -> the first feature.

def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = training_requests(spark, sf_dir)
    k = F.col("request_id")
    gt = (F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit(""))
          .when(k % 4 == 2, F.col("target_column")).otherwise(F.element_at("feature_columns", 1)))
    return r.select("request_id", "dataset_id", F.col("target_column").alias("manifest_target"),
                    "feature_columns", gt.alias("ground_truth_arg"))


SCORING_REQUESTS_SQL = f"""
SELECT request_id, dataset_id, target_column AS manifest_target, feature_columns,
       CASE request_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN target_column
            ELSE feature_columns[1] END AS ground_truth_arg
FROM ({TRAINING_REQUESTS_SQL})"""
