"""Estimators against small numpy re-computations and invariants."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators.boost import NewtonBoostParams, fit_newton_boost
from tessera.operators.linear import ols_fit
from tessera.operators.svd import fit_truncated_svd
from tessera.operators.trees import FlatTrees
from tessera.plans.fixtures import table

from conftest import SF_SMALL


def test_ols_matches_numpy(spark):
    p = table(spark, SF_SMALL, "part").select("p_partkey", "p_retailprice").toPandas()
    slope, icpt = np.polyfit(p.p_partkey.astype(float), p.p_retailprice, 1)
    r = ols_fit(table(spark, SF_SMALL, "part"), "p_partkey", "p_retailprice").first()
    assert r["slope"] == pytest.approx(slope, rel=1e-9) and r["intercept"] == pytest.approx(icpt, rel=1e-9)


def test_flat_tree_walk(spark):
    t = FlatTrees(features=["x", "y"])
    t.add_tree([{"feat": 0, "thr": 1.0, "left": 1, "right": 2, "value": 0},
                {"feat": -1, "left": -1, "right": -1, "value": 10.0},
                {"feat": 1, "thr": 5.0, "left": 3, "right": 4, "value": 0},
                {"feat": -1, "left": -1, "right": -1, "value": 20.0},
                {"feat": -1, "left": -1, "right": -1, "value": 30.0}], weight=2.0)
    df = spark.createDataFrame([(0.5, 0.0), (2.0, 4.0), (2.0, 9.0)], "x double, y double")
    assert [r[0] for r in df.select(t.predict_expr()).collect()] == [20.0, 40.0, 60.0]


def _part_features(spark):
    p = table(spark, SF_SMALL, "part")
    return VectorAssembler(inputCols=["p_partkey", "p_size"], outputCol="features").transform(p)


def test_newton_boost_training_error_decreases(spark):
    df = _part_features(spark)
    errs = []
    for n in (1, 3, 6):
        m = fit_newton_boost(df, "features", "p_retailprice", NewtonBoostParams(n_estimators=n, max_depth=3), 2)
        out = m.transform(df)
        errs.append(out.agg(F.avg((F.col("prediction") - F.col("p_retailprice")) ** 2)).first()[0])
    assert errs[0] >= errs[1] >= errs[2]


def test_newton_boost_logistic_probabilities(spark):
    df = _part_features(spark).withColumn("y", (F.col("p_retailprice") > 950).cast("double"))
    m = fit_newton_boost(df, "features", "y", NewtonBoostParams(objective="logistic", n_estimators=5, max_depth=3), 2)
    out = m.transform(df)
    acc = out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.7
    assert out.filter((F.col("probability")[1] < 0) | (F.col("probability")[1] > 1)).count() == 0


def test_svd_matches_numpy(spark):
    from pyspark.ml.functions import array_to_vector
    e = table(spark, SF_SMALL, "embeddings")
    v = e.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    m = fit_truncated_svd(v, "features", 4)
    a = np.array([r[0] for r in e.select("embedding").collect()], dtype=float)
    s = np.linalg.svd(a, compute_uv=False)[:4]
    assert np.allclose(m.singular_values, s, rtol=1e-6)


def test_train_without_keys_uses_whole_rows(spark):
    """No key columns: rows (with copies) are the key; every row is out-of-fold once."""
    from tessera.operators.train import TrainSpec, train
    p = table(spark, SF_SMALL, "part").select("p_partkey", "p_size", "p_retailprice")
    copies = p.limit(20).unionByName(p.limit(20))
    df = p.unionByName(copies)
    res = train(df, TrainSpec(features=["p_partkey", "p_size"], target="p_retailprice",
                              algorithm="random_forest", hyperparameters={"n_estimators": "5", "max_depth": "4"},
                              cv_folds=3))
    assert res.oof.count() == df.count()
    assert res.metrics.first()["r2"] is not None


def test_training_passes_have_a_task_per_slot(spark, monkeypatch):
    from tessera.operators import train as t
    from tessera.session import sql_conf
    df = spark.range(400).selectExpr("id", "id % 7 as a", "id % 7 + 0.5 as y")
    spec = t.TrainSpec(features=["a"], target="y", algorithm="linear_regression", key_cols=["id"])
    seen, fit = [], t.fit_pipeline
    monkeypatch.setattr(t, "fit_pipeline", lambda data, *a: (seen.append(data.rdd.getNumPartitions()), fit(data, *a))[1])
    with sql_conf(spark, spark__sql__shuffle__partitions="50", spark__sql__adaptive__enabled="false"):
        slots = spark.sparkContext.defaultParallelism
        assert t.train(df, spec).oof.count() == 400
        assert len(seen) == 6 and max(seen) <= slots
        monkeypatch.setattr(t, "ROWS_PER_TASK", 400 // (2 * slots))
        assert t.fit_partitions(df) >= 2 * slots
