"""Fold assignment, out-of-fold OLS and CV metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.folds import kfold_assign, stratified_kfold_assign
from tessera.operators.linear import ols_fit, oof_ols
from tessera.plans.catalog import query
from tessera.plans.fixtures import ORDERS_NA_SQL, orders_na, table
from tessera.plans.sqlfrag import classification_sql

K = 5
SEED = 42
ORDER_KEY_SQL = "md5('42|' || CAST(o_orderkey AS VARCHAR))"
FOLD_SQL = f"CAST((row_number() OVER (ORDER BY {ORDER_KEY_SQL}, o_orderkey) - 1) % {K} AS INTEGER)"
STRAT_FOLD_SQL = (f"CAST((row_number() OVER (ORDER BY o_orderstatus, {ORDER_KEY_SQL}, o_orderkey) - 1) % {K} "
                  "AS INTEGER)")


def orders_folds(spark, sf_dir):
    return kfold_assign(table(spark, sf_dir, "orders"), ["o_orderkey"], k=K, seed=SEED)


@query("kfold_assign", f"SELECT o_orderkey, {FOLD_SQL} AS fold FROM orders")
def q_kfold_assign(spark, sf_dir):
    return orders_folds(spark, sf_dir).select("o_orderkey", "fold")


@query("stratified_kfold_assign", f"SELECT o_orderkey, o_orderstatus, {STRAT_FOLD_SQL} AS fold FROM orders")
def q_stratified_kfold_assign(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return stratified_kfold_assign(o, ["o_orderkey"], "o_orderstatus", k=K, seed=SEED) \
        .select("o_orderkey", "o_orderstatus", "fold")


OOF_SQL = f"""
WITH src AS (SELECT *, {FOLD_SQL} AS fold FROM ({ORDERS_NA_SQL})),
u AS (SELECT * FROM src WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL),
per AS (SELECT fold, count(*) AS n, sum(CAST(o_custkey AS DOUBLE)) AS sx, sum(o_totalprice) AS sy,
               sum(CAST(o_custkey AS DOUBLE) * o_custkey) AS sxx, sum(o_custkey * o_totalprice) AS sxy FROM u GROUP BY fold),
c AS (SELECT fold, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy,
             sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM per),
fit AS (SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS slope FROM c),
fit2 AS (SELECT fit.fold, slope, c.sy / c.n - slope * c.sx / c.n AS icpt FROM fit JOIN c ON c.fold = fit.fold),
oof AS (SELECT u.o_orderkey, u.fold, u.o_totalprice, fit2.icpt + fit2.slope * u.o_custkey AS p
        FROM u JOIN fit2 ON fit2.fold = u.fold)"""


def _oof(spark, sf_dir):
    o = kfold_assign(orders_na(spark, sf_dir), ["o_orderkey"], k=K, seed=SEED)
    return oof_ols(o, "o_custkey", "o_totalprice", "fold")


@query("oof_ols", OOF_SQL + "\nSELECT o_orderkey, fold, round(p, 4) AS oof_prediction FROM oof")
def q_oof_ols(spark, sf_dir):
    return _oof(spark, sf_dir).select("o_orderkey", "fold", F.round("oof_prediction", 4).alias("oof_prediction"))


@query("metric_cv_regression", OOF_SQL + """,
pf AS (SELECT fold, sqrt(avg((p - o_totalprice) * (p - o_totalprice))) AS rmse, avg(abs(p - o_totalprice)) AS mae,
              CASE WHEN var_pop(o_totalprice) * count(*) = 0 THEN 0.0
                   ELSE 1.0 - sum((p - o_totalprice) * (p - o_totalprice)) / (var_pop(o_totalprice) * count(*)) END AS r2
       FROM oof GROUP BY fold)
SELECT (SELECT round(avg(rmse), 4) FROM pf) AS rmse, (SELECT round(stddev_pop(rmse), 4) FROM pf) AS rmse_std,
       (SELECT round(avg(mae), 4) FROM pf) AS mae, (SELECT round(avg(r2), 6) FROM pf) AS r2,
       round(100.0 * avg(abs(p - o_totalprice) / greatest(abs(o_totalprice), 2.220446049250313e-16)), 6) AS mape,
       round(max(abs(p - o_totalprice)), 4) AS max_error,
       round(CASE WHEN stddev_pop(o_totalprice) * stddev_pop(p) = 0 THEN 0.0
                  ELSE covar_pop(o_totalprice, p) / (stddev_pop(o_totalprice) * stddev_pop(p)) END, 6) AS pearson_r,
       round(avg(o_totalprice), 4) AS target_mean
FROM oof""")
def q_metric_cv_regression(spark, sf_dir):
    m = M.cv_regression_metrics(_oof(spark, sf_dir), "fold", "o_totalprice", "oof_prediction")
    # large-magnitude errors are compared at 4 decimals (summation order differs by engine)
    return m.select(*[F.round(c, 4).alias(c) if c in ("rmse", "rmse_std", "mae", "max_error", "target_mean") else F.col(c)
                      for c in m.columns])


@query("train_ols", f"""
SELECT round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept,
       count(*) AS n
FROM ({ORDERS_NA_SQL}) WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def q_train_ols(spark, sf_dir):
    f = ols_fit(orders_na(spark, sf_dir), "o_custkey", "o_totalprice")
    return f.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


# Classification CV metrics: out-of-fold rule predictions of the order status from the
# total price band (a fixed stump per fold is the same model in every fold, so the
# per-fold metrics differ only by the rows each fold holds).
STATUS_RULE_SQL = "CASE WHEN o_totalprice > 150000 THEN 'O' ELSE 'F' END"


@query("metric_cv_classification", f"""
WITH src AS (SELECT o_orderstatus AS y, {STATUS_RULE_SQL} AS p,
                    {STRAT_FOLD_SQL} AS fold FROM orders),
{classification_sql('src', 'y', 'p', group='fold', rounded=False).strip()}
SELECT round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM cm""")
def q_metric_cv_classification(spark, sf_dir):
    o = stratified_kfold_assign(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderstatus", k=K, seed=SEED)
    o = o.withColumn("p", F.when(F.col("o_totalprice") > 150000, F.lit("O")).otherwise(F.lit("F")))
    return M.cv_classification_metrics(o, "fold", "o_orderstatus", "p")


# ROC AUC on labels joined to documents: score = n_chars (a longer document scores
# higher), positive class = quality 1 (the second class in sorted order).
@query("metric_roc_auc", """
WITH d AS (SELECT l.quality, CAST(d.n_chars AS DOUBLE) AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
r AS (SELECT quality, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM d)
SELECT round((sum(CASE WHEN quality = 1 THEN ar END) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2.0)
             / (count_if(quality = 1) * count_if(quality = 0)), 6) AS roc_auc FROM r""")
def q_metric_roc_auc(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return M.roc_auc(lab.join(docs, "doc_id"), "quality", "n_chars")


@query("ols_fit_score", f"""
WITH src AS ({ORDERS_NA_SQL}),
fit AS (SELECT regr_slope(o_totalprice, o_custkey) AS slope, regr_intercept(o_totalprice, o_custkey) AS icpt
        FROM src WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL)
SELECT o_orderkey, round(fit.icpt + fit.slope * o_custkey, 4) AS prediction
FROM src, fit WHERE o_custkey IS NOT NULL""")
def q_ols_fit_score(spark, sf_dir):
    """Fit on rows with both values, score every row that has the feature. The fit
    is a one-row aggregate used through scalar subqueries (no join)."""
    o = orders_na(spark, sf_dir)
    fit = ols_fit(o, "o_custkey", "o_totalprice")
    # one scalar subquery carrying both coefficients (the fit runs once)
    coef = fit.select(F.struct("slope", "intercept").alias("c")).scalar()
    slope, icpt = coef.getField("slope"), coef.getField("intercept")
    return o.filter(F.col("o_custkey").isNotNull()).select(
        "o_orderkey", F.round(icpt + slope * F.col("o_custkey"), 4).alias("prediction"))
