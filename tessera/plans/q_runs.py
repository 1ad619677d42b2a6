"""Training and scoring runs with their records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.train import TrainSpec, train
from tessera.plans.catalog import query
from tessera.plans.fixtures import LINEITEM_NA_SQL, ORDERS_NA_SQL, lineitem_na, orders_na
from tessera.plans.q_folds import FOLD_SQL
from tessera.plans.q_score import KEPT_SQL, PRICE_MANIFEST, PRICE_MODEL, PRICE_SQL
from tessera.session import scratch_path
from tessera.sources import runs as RN
from tessera.sources import store as S

# Total price from customer key by least squares; orders with a key divisible by 7 are the external test set,
# those divisible by 11 are evaluated later. Rows without a value are left out.
SPEC = TrainSpec(features=["o_custkey"], target="o_totalprice", algorithm="linear_regression", numeric_imputer="drop",
                 key_cols=["o_orderkey"])
SRC_SQL = f"""
WITH whole AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM ({ORDERS_NA_SQL})
               WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL),
src AS (SELECT *, {FOLD_SQL} AS fold FROM whole WHERE o_orderkey % 7 <> 0),
fit AS (SELECT f.fold, regr_slope(s.y, s.x) AS b, regr_intercept(s.y, s.x) AS a
        FROM (SELECT DISTINCT fold FROM src) f JOIN src s ON s.fold <> f.fold GROUP BY f.fold),
oof AS (SELECT src.fold, src.y, fit.a + fit.b * src.x AS p FROM src JOIN fit ON fit.fold = src.fold),
per AS (SELECT fold, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae,
               1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2 FROM oof GROUP BY fold),
final AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM src)"""


def _test_sql(divisor):
    return (f"(SELECT round(sqrt(avg((a + b * x - y) * (a + b * x - y))), 3) FROM whole, final WHERE o_orderkey % {divisor} = 0) AS test_rmse, "
            f"(SELECT round(1 - sum((a + b * x - y) * (a + b * x - y)) / (var_pop(y) * count(*)), 6) FROM whole, final "
            f"WHERE o_orderkey % {divisor} = 0) AS test_r2")


def _orders(spark, sf_dir):
    o = orders_na(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice").filter("o_custkey is not null")
    return o.filter("o_orderkey % 7 <> 0"), o.filter("o_orderkey % 7 = 0"), o.filter("o_orderkey % 11 = 0")


def _record(spark, root):
    r = S.scan_trained_models(spark, root)
    return r.select("id", "name", "algorithm", "problem_type", "target_column", "status", F.col("feature_columns")[0].alias("feature"),
                    F.round("validation_rmse", 3).alias("validation_rmse"), F.round("validation_r2", 6).alias("validation_r2"),
                    F.round("test_rmse", 3).alias("test_rmse"), F.round("test_r2", 6).alias("test_r2"))


_RECORD_SQL = """'order-price' AS id, 'Order price' AS name, 'linear_regression' AS algorithm, 'regression' AS problem_type,
       'o_totalprice' AS target_column, 'draft' AS status, 'o_custkey' AS feature,
       (SELECT round(avg(rmse), 3) FROM per) AS validation_rmse, (SELECT round(avg(r2), 6) FROM per) AS validation_r2"""


def _trained(spark, sf_dir, root):
    data, test, _ = _orders(spark, sf_dir)
    RN.save_run(train(data, SPEC, test=test), root, "order-price", "Order price")


@query("training_record", f"{SRC_SQL} SELECT {_RECORD_SQL}, {_test_sql(7)}")
def q_training_record(spark, sf_dir):
    """A run with an external test set, saved, its record read back."""
    root = scratch_path(spark, "trained")
    _trained(spark, sf_dir, root)
    return _record(spark, root)


@query("evaluate_record", f"{SRC_SQL} SELECT {_RECORD_SQL}, {_test_sql(11)}")
def q_evaluate_record(spark, sf_dir):
    """The stored model evaluated on another table; its record has the new test metrics."""
    root = scratch_path(spark, "trained")
    _trained(spark, sf_dir, root)
    RN.evaluate_run(spark, root, "order-price", _orders(spark, sf_dir)[2])
    return _record(spark, root)


@query("cv_scores_ols", f"{SRC_SQL} SELECT fold, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(r2, 6) AS r2 FROM per")
def q_cv_scores_ols(spark, sf_dir):
    """Scores of each fold."""
    res = train(_orders(spark, sf_dir)[0], SPEC)
    m = M.regression_metrics(res.oof, "label", "prediction", group_by=["fold"])
    return m.select("fold", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"))


# One scoring run per return flag, the first one done twice.
@query("scoring_runs", f"""
WITH src AS ({LINEITEM_NA_SQL})
SELECT 'flag-' || l_returnflag AS run_id, 'price-linear' AS model_id, 'Price' AS model_name, 'flag_' || l_returnflag || '.csv' AS source_filename,
       count(*) AS row_count, count(*) AS rows_read, round(sum(round({PRICE_SQL}, 4)), 2) AS total
FROM src WHERE l_returnflag IS NOT NULL AND {KEPT_SQL} GROUP BY l_returnflag""")
def q_scoring_runs(spark, sf_dir):
    """History written per run, by run id; rows of runs that the history names."""
    rows, out, hist = lineitem_na(spark, sf_dir), scratch_path(spark, "predictions"), scratch_path(spark, "history")
    flags = sorted(r[0] for r in rows.select("l_returnflag").filter("l_returnflag is not null").distinct().collect())       # three flags
    for flag in [*flags, flags[0]] if flags else []:
        RN.score_run(rows.filter(F.col("l_returnflag") == flag), PRICE_MANIFEST, PRICE_MODEL, out, hist, f"flag-{flag}",
                     source=f"uploads\\in/flag_{flag}.csv", ground_truth="l_extendedprice")
    read = RN.read_predictions(spark, out, hist).groupBy("run_id").agg(
        F.count("*").alias("rows_read"), F.round(F.sum("price_prediction"), 2).alias("total"))
    return RN.read_history(spark, hist).withColumnRenamed("id", "run_id").join(read, "run_id").select(
        "run_id", "model_id", "model_name", "source_filename", "row_count", "rows_read", "total")
