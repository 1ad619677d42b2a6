"""Estimators where their fit has a closed form (E1-E9, S14): one 0/1 feature, one tree of depth 1 or one round.

A tree's leaves are then group means; one Newton round moves the base by a leaf weight; the first AdaBoost
round is its tree; logistic regression without a penalty reproduces the classes' shares.

Inputs from ``part``: x = 1 where p_size > 25; y = p_retailprice + 300 x; class 'yes' where 7 * p_partkey mod 10 < 3 + 4 x.
Forests draw their rows with repetition, so theirs are targets that x decides (100 + 300 x; 'yes' where x = 1): every tree
must find them whatever it drew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.train import TrainSpec, fit_pipeline, prepare_training_frame
from tessera.plans.catalog import query
from tessera.plans.fixtures import table
from tessera.session import scratch_path
from tessera.sources.models import load_pipeline, save_pipeline

SRC_SQL = """
WITH s AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END AS x, p_retailprice FROM part),
src AS (SELECT p_partkey, x, p_retailprice + 300 * x AS y, CASE WHEN (7 * p_partkey) % 10 < 3 + 4 * x THEN 1.0 ELSE 0.0 END AS c FROM s),
g AS (SELECT x, count(*) AS n, avg(y) AS mean_y, sum(y) AS sum_y, avg(c) AS share, sum(c) AS ones, (SELECT avg(y) FROM src) AS base_y,
             (SELECT avg(c) FROM src) AS base_c FROM src GROUP BY x)
"""
REGRESSION = "SELECT CAST(x AS DOUBLE) AS x, n, round({}, 4) AS prediction FROM g"
CLASSES = "SELECT CAST(x AS DOUBLE) AS x, n, CASE WHEN {0} > 0.5 THEN 'yes' ELSE 'no' END AS prediction, round({0}, {1}) AS probability FROM g"


def _frame(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = F.when(F.col("p_size") > 25, F.lit(1.0)).otherwise(F.lit(0.0))
    return p.select("p_partkey", x.alias("x"), (F.col("p_retailprice") + 300 * x).alias("y"),
                    F.when((7 * F.col("p_partkey")) % 10 < 3 + 4 * x, F.lit("yes")).otherwise(F.lit("no")).alias("c"),
                    (100 + 300 * x).alias("y_x"), F.when(x == 1, F.lit("yes")).otherwise(F.lit("no")).alias("c_x"))


def _fit(spark, sf_dir, algorithm, decided=False, **hp):
    classes = algorithm.endswith("_classifier") or algorithm == "logistic_regression"
    spec = TrainSpec(features=["x"], target=("c" if classes else "y") + ("_x" if decided else ""), problem_type="classification" if classes else "regression",
                     algorithm=algorithm, hyperparameters=hp, key_cols=["p_partkey"])
    data, num, cat, labels = prepare_training_frame(_frame(spark, sf_dir), spec)
    return fit_pipeline(data, spec, num, cat, labels), data


def _regression(spark, sf_dir, algorithm, **hp):
    model, data = _fit(spark, sf_dir, algorithm, **hp)
    return model.transform(data).groupBy("x").agg(F.count("*").alias("n"), F.round(F.max("prediction"), 4).alias("prediction"))


def _classes(spark, sf_dir, algorithm, digits, **hp):
    model, data = _fit(spark, sf_dir, algorithm, **hp)
    return model.transform(data).groupBy("x").agg(F.count("*").alias("n"), F.max("prediction").alias("prediction"),
                                                  F.round(F.max(F.col("probability")[1]), digits).alias("probability"))


@query("closed_random_forest", SRC_SQL + REGRESSION.format("100 + 300 * x"))
def q_forest(spark, sf_dir):
    return _regression(spark, sf_dir, "random_forest", decided=True, n_estimators="5", max_depth="1")


@query("closed_gradient_boosting", SRC_SQL + REGRESSION.format("mean_y"))
def q_gbt(spark, sf_dir):
    """The first tree fits the target itself, whatever the learning rate."""
    return _regression(spark, sf_dir, "gradient_boosting", n_estimators="1", max_depth="1")


@query("closed_newton", SRC_SQL + REGRESSION.format("base_y + 0.3 * (sum_y - n * base_y) / (n + 1.0)"))
def q_newton(spark, sf_dir):
    return _regression(spark, sf_dir, "xgboost", n_estimators="1", max_depth="1", learning_rate="0.3")


@query("closed_adaboost", SRC_SQL + REGRESSION.format("mean_y"))
def q_adaboost(spark, sf_dir):
    return _regression(spark, sf_dir, "adaboost", n_estimators="1")


@query("closed_random_forest_classifier", SRC_SQL + CLASSES.format("x", 6))
def q_forest_classifier(spark, sf_dir):
    return _classes(spark, sf_dir, "random_forest_classifier", 6, decided=True, n_estimators="5", max_depth="1")


@query("closed_gbt_classifier", SRC_SQL + CLASSES.format("(1 / (1 + exp(-2 * (2 * share - 1))))", 6))
def q_gbt_classifier(spark, sf_dir):
    """One tree on -1 / 1: its margin is twice the share less one."""
    return _classes(spark, sf_dir, "gradient_boosting_classifier", 6, n_estimators="1", max_depth="1")


@query("closed_newton_classifier", SRC_SQL + CLASSES.format(
    "(1 / (1 + exp(-(ln(base_c / (1 - base_c)) + 0.3 * (ones - n * base_c) / (n * base_c * (1 - base_c) + 1.0)))))", 6))
def q_newton_classifier(spark, sf_dir):
    return _classes(spark, sf_dir, "xgboost_classifier", 6, n_estimators="1", max_depth="1", learning_rate="0.3")


@query("closed_adaboost_classifier", SRC_SQL + "SELECT CAST(x AS DOUBLE) AS x, n, CASE WHEN share > 0.5 THEN 'yes' ELSE 'no' END AS prediction FROM g")
def q_adaboost_classifier(spark, sf_dir):
    model, data = _fit(spark, sf_dir, "adaboost_classifier", n_estimators="1")
    return model.transform(data).groupBy("x").agg(F.count("*").alias("n"), F.max("prediction").alias("prediction"))


@query("closed_logistic_regression", SRC_SQL + CLASSES.format("share", 2))
def q_logistic(spark, sf_dir):
    return _classes(spark, sf_dir, "logistic_regression", 2, C="1000000", penalty="l2")


@query("model_round_trip", SRC_SQL + """
SELECT p_partkey, round(regr_intercept(y, x) OVER () + regr_slope(y, x) OVER () * x, 4) AS before,
       round(regr_intercept(y, x) OVER () + regr_slope(y, x) OVER () * x, 4) AS after FROM src""")
def q_model_round_trip(spark, sf_dir):
    """Least squares, predictions before and after a save and load."""
    model, data = _fit(spark, sf_dir, "linear_regression")
    again = load_pipeline(save_pipeline(model, scratch_path(spark, "model")))
    a = model.transform(data).select("p_partkey", F.round("prediction", 4).alias("before"))
    return a.join(again.transform(data).select("p_partkey", F.round("prediction", 4).alias("after")), "p_partkey")
