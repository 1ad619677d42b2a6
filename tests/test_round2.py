"""Probes of round 1's findings."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import retry_delay
from tessera.operators import joblog, linear, metrics, profile, svd
from tessera.operators.score import FeatureSpec, LinearModel, Manifest, score
from tessera.operators.train import TrainSpec, prepare_training_frame
from tessera.sources import store


def _manifest():
    return Manifest(id="m", name="m", features=(FeatureSpec("x", "float64"),))


def test_scoring_refuses_bad_values_without_ground_truth(spark):
    df = spark.createDataFrame([("5", 1), ("abc", 2), ("7", 3)], "x string, _id int")
    res = score(df, _manifest(), LinearModel(0.0, {"x": 2.0}), ground_truth="")
    with pytest.raises(Exception, match="must contain"):
        res.predictions.collect()
    with pytest.raises(Exception, match="must contain"):
        res.guards.collect()


def test_scoring_keeps_underscored_columns_and_counts_rows(spark):
    df = spark.createDataFrame([("5", 1), (None, 2)], "x string, _id int")
    res = score(df, _manifest(), LinearModel(0.0, {"x": 2.0}), ground_truth="")
    assert [r["_id"] for r in res.predictions.collect()] == [1]
    assert tuple(res.guards.first()) == (1, 1)
    none = score(df.filter("_id = 2"), _manifest(), LinearModel(0.0, {"x": 2.0}), ground_truth="")
    with pytest.raises(Exception, match="no rows left"):
        none.guards.collect()


def test_retry_rule(spark):
    rows = [("a", "failed", 0, "ConnectionError"), ("b", "failed", 1, "KeyError"), ("c", "failed", 2, None), ("d", "failed", 3, "OSError")]
    df = spark.createDataFrame(rows, "job_id string, status string, attempt int, error_class string")
    out = {r.job_id: (r.retryable, r.delay_seconds) for r in joblog.retry_plan(df).collect()}
    assert out == {"a": (True, 2.0), "b": (False, None), "c": (False, None), "d": (False, None)}
    assert spark.range(1).select(retry_delay(F.lit(3))).first()[0] == 8.0


def test_ols_far_from_zero_and_constant(spark):
    df = spark.range(1000).select((F.col("id") + 1e9).alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") % 5).alias("fold"))
    fit = linear.ols_fit(df, "x", "y").first()
    assert abs(fit.slope - 2.0) < 1e-9
    worst = linear.oof_ols(df, "x", "y", "fold").agg(F.max(F.abs(F.col("oof_prediction") - F.col("y")))).first()[0]
    assert worst < 1e-3
    same = df.withColumn("x", F.lit(3.0))
    assert linear.ols_fit(same, "x", "y").first().slope is None
    assert linear.oof_ols(same, "x", "y", "fold").filter("oof_prediction is not null").count() == 0


@pytest.mark.parametrize("algorithm,params", [("random_forest", {"max_depth": "40"}), ("gradient_boosting", {"learning_rate": "0"}),
                                              ("gradient_boosting", {"n_estimators": "0"})])
def test_parameters_are_refused_not_replaced(algorithm, params):
    with pytest.raises(ValueError):
        TrainSpec(features=["x"], target="y", problem_type="regression", algorithm=algorithm, hyperparameters=params).check()


def test_unknown_penalty_is_refused():
    with pytest.raises(ValueError, match="penalty"):
        TrainSpec(features=["x"], target="y", problem_type="classification", algorithm="logistic_regression",
                  hyperparameters={"penalty": "elasticnet"}).check()


def test_text_regression_target_stops_training(spark):
    df = spark.createDataFrame([(1.0, "1.5"), (2.0, "oops")], "x double, y string")
    spec = TrainSpec(features=["x"], target="y", problem_type="regression", algorithm="random_forest")
    with pytest.raises(Exception, match="must be numeric"):
        prepare_training_frame(df, spec)[0].collect()


def test_more_components_than_columns(spark):
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double"))
    with pytest.raises(ValueError):
        svd.fit_truncated_svd(df, "v", 10)


def test_dataset_ids_stay_text(spark, tmp_dir):
    df = spark.createDataFrame([("007", 1), ("1e3", 2), ("x", 3)], "d string, v int")
    root = store.store_datasets(df, f"{tmp_dir}/ds", F.col("d"))
    assert store.scan_dataset(spark, root, "007").first().v == 1 and store.scan_dataset(spark, root, "1e3").first().v == 2


def test_wide_integers_lose_no_digit(spark):
    a, b = 2 ** 53, 2 ** 53 + 1
    stats = profile.value_stats(spark.createDataFrame([(a,), (b,), (b,)], "k long")).first()
    assert (stats.unique_count, stats["mode"]) == (2, str(b))
    text = spark.createDataFrame([("123456789012345678901234", "1", "12345678901234567890123"), ("5", "2", "0.5")],
                                 "wide string, narrow string, mixed string")
    types = {r.name: r.raw_dtype for r in profile.infer_types(text).collect()}
    assert types == {"wide": "string", "narrow": "bigint", "mixed": "double"}


def test_statistics_that_are_not_asked_for_are_not_planned(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "x double, t string")
    plan = profile.column_stats(df, quartiles=False)._jdf.queryExecution().toString()
    assert "percentile" not in plan
    r = profile.column_stats(df, quartiles=False, moments=False).collect()
    assert [(x.n, x.missing_count, x.minimum, x.q1) for x in r] == [(2, 1, None, None), (2, 0, None, None)]


def test_indented_documents_are_read(spark, tmp_path):
    for i in ("a", "b"):
        (tmp_path / i).mkdir()
        (tmp_path / i / "metadata.json").write_text(json.dumps({"id": "m" + i, "name": i}, indent=2))
        (tmp_path / i / "record.json").write_text(json.dumps({"id": "r" + i, "completed_at": "2024-01-0" + str(ord(i) - 96)}, indent=2))
        (tmp_path / i / "notes.json").write_text("[1, 2")
    m = {r.id: r.package_dir for r in store.scan_manifests(spark, str(tmp_path)).collect()}
    assert m == {"ma": "a", "mb": "b"}
    assert [r.id for r in store.scan_trained_models(spark, str(tmp_path)).collect()] == ["rb", "ra"]


def test_cv_regression_carries_the_target_mean(spark):
    df = spark.createDataFrame([(0, 1.0, 1.5), (0, 3.0, 2.0), (1, 8.0, 8.0)], "fold int, y double, p double")
    assert metrics.cv_regression_metrics(df, "fold", "y", "p").first().target_mean == 4.0


def test_all_subclasses_of_transient_errors_are_retried(spark):
    import builtins
    names = {c.__name__ for c in vars(builtins).values() if isinstance(c, type) and issubclass(c, OSError)}
    names |= {"RedisError", "BusyLoadingError", "ReadOnlyError", "ClusterDownError", "gaierror"}
    rows = [(i, "failed", 1, n) for i, n in enumerate([*sorted(names), "ValueError", None])]
    df = spark.createDataFrame(rows, "job_id long, status string, attempt int, error_class string")
    out = {r.error_class: (r.retryable, r.delay_seconds) for r in joblog.retry_plan(df).collect()}
    assert {n for n, (again, _) in out.items() if again} == names and out["ValueError"] == out[None] == (False, None)
