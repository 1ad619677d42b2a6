"""Forest post-pruning: conversion fidelity and the two growth limits."""
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tessera.operators.prune import prune_forest, prune_tree
from tessera.plans.fixtures import table

from conftest import SF_SMALL


def _part(spark):
    p = table(spark, SF_SMALL, "part")
    return VectorAssembler(inputCols=["p_partkey", "p_size"], outputCol="features").transform(p) \
        .withColumn("label", F.col("p_retailprice"))


def test_unpruned_conversion_reproduces_spark_regressor(spark):
    df = _part(spark)
    m = RandomForestRegressor(numTrees=5, maxDepth=5, seed=1).fit(df)
    flat = prune_forest(m, spark, False, 0, None, None)
    a = m.transform(df).select("p_partkey", F.col("prediction").alias("a"))
    b = flat.transform(df).select("p_partkey", F.col("prediction").alias("b"))
    diff = a.join(b, "p_partkey").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert diff < 1e-9


def test_unpruned_conversion_reproduces_spark_classifier(spark):
    df = _part(spark).withColumn("label", (F.col("p_partkey") > 100).cast("double"))
    m = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(df)
    flat = prune_forest(m, spark, True, 2, None, None)
    a = m.transform(df).select("p_partkey", F.col("prediction").alias("a"))
    b = flat.transform(df).select("p_partkey", F.col("prediction").alias("b"))
    assert a.join(b, "p_partkey").filter(F.col("a") != F.col("b")).count() == 0


def _tree():
    # root(100) -> A(60, gain small) / B(40, gain large); A -> A1(30) / A2(30); B -> B1(5) / B2(35)
    def n(l, r, c, imp, f=0):
        return {"left": l, "right": r, "feat": f if l >= 0 else -1, "thr": 0.5, "count": c, "impurity": imp,
                "prediction": 0.0, "stats": []}
    return {0: n(1, 2, 100, 1.0), 1: n(3, 4, 60, 0.5), 2: n(5, 6, 40, 0.9),
            3: n(-1, -1, 30, 0.45), 4: n(-1, -1, 30, 0.45), 5: n(-1, -1, 5, 0.0), 6: n(-1, -1, 35, 0.1)}


def _leaves(t):
    seen, stack = [], [0]
    while stack:
        i = stack.pop()
        if t[i]["left"] < 0:
            seen.append(i)
        else:
            stack += [t[i]["left"], t[i]["right"]]
    return sorted(seen)


def test_max_leaf_nodes_expands_best_first():
    # gains: root 100-30-36=34, A 30-13.5-13.5=3, B 36-0-3.5=32.5 -> with 3 leaves expand root then B
    assert _leaves(prune_tree(_tree(), None, 3)) == [1, 5, 6]


def test_min_samples_split_collapses_small_nodes():
    assert _leaves(prune_tree(_tree(), 50, None)) == [2, 3, 4]


def test_pruned_forest_survives_save_and_load(spark):
    from tessera.operators.train import TrainSpec, fit_pipeline, prepare_training_frame
    from tessera.session import scratch_path
    from tessera.sources.models import load_pipeline, save_pipeline
    p = table(spark, SF_SMALL, "part").select("p_partkey", "p_size", "p_retailprice")
    spec = TrainSpec(features=["p_partkey", "p_size"], target="p_retailprice", algorithm="random_forest",
                     hyperparameters={"n_estimators": "3", "max_depth": "4", "max_leaf_nodes": "6"}, key_cols=["p_partkey"])
    data, num, cat, labels = prepare_training_frame(p, spec)
    m = fit_pipeline(data, spec, num, cat, labels)
    again = load_pipeline(save_pipeline(m, scratch_path(spark, "pruned")))
    a = m.transform(data).select("p_partkey", F.col("prediction").alias("a"))
    b = again.transform(data).select("p_partkey", F.col("prediction").alias("b"))
    assert a.join(b, "p_partkey").filter(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_classifiers_score_in_a_session_that_has_observed(spark):
    """A binary classifier's training summary holds the session, which cannot be sent to tasks once a query was observed."""
    from pyspark.sql import Observation
    from tessera.operators.train import TrainSpec, fit_pipeline, prepare_training_frame
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 5
    df = spark.range(60).selectExpr("id", "id % 7 as x", "if(id % 7 > 3, 'a', 'b') as y")
    for algorithm, hp in (("random_forest_classifier", {"n_estimators": "3", "max_depth": "3"}), ("logistic_regression", {})):
        spec = TrainSpec(features=["x"], target="y", problem_type="classification", algorithm=algorithm, hyperparameters=hp, key_cols=["id"])
        data, num, cat, labels = prepare_training_frame(df, spec)
        out = fit_pipeline(data, spec, num, cat, labels).transform(data)
        assert out.filter(F.col("prediction") != F.col("y")).count() == 0
