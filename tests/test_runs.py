"""Run records: whole or absent, replaced by repeated runs."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.score import FeatureSpec, LinearModel, Manifest
from tessera.operators.train import TrainSpec, train
from tessera.sources import runs as RN
from tessera.sources import store as S
from tessera.streaming.scoring import score_stream

MANIFEST = Manifest(id="m/1", name="Model", features=(FeatureSpec("x", "float64"),), target="y")
MODEL = LinearModel(1.0, {"x": 2.0})


def _rows(spark, n, first=0):
    return spark.range(first, first + n).select("id", F.col("id").cast("double").alias("x"), (2.0 * F.col("id")).alias("y"))


def test_a_repeated_run_counts_once(spark, tmp_dir):
    out, hist = f"{tmp_dir}/out", f"{tmp_dir}/hist"
    for n, run in ((5, "a"), (7, "b"), (6, "a")):
        RN.score_run(_rows(spark, n), MANIFEST, MODEL, out, hist, run, source="in\\x/file.csv")
    rows = {r.id: r for r in RN.read_history(spark, hist).collect()}
    assert {k: r.row_count for k, r in rows.items()} == {"a": 6, "b": 7}
    assert rows["a"].model_name == "Model" and rows["a"].source_filename == "file.csv" and rows["a"].created_at
    assert RN.read_predictions(spark, out, hist).groupBy("run_id").count().collect() and \
        RN.read_predictions(spark, out, hist).count() == 13
    assert not [f for f in os.listdir(hist) if f.endswith(".tmp")]


def test_a_failed_run_leaves_no_history(spark, tmp_dir):
    out, hist = f"{tmp_dir}/out", f"{tmp_dir}/hist"
    RN.score_run(_rows(spark, 3), MANIFEST, MODEL, out, hist, "good", source="s")
    with pytest.raises(Exception, match="at least one data row"):
        RN.score_run(_rows(spark, 0), MANIFEST, MODEL, out, hist, "none", source="s")
    bad = spark.createDataFrame([("1",), ("x",)], "x string")
    with pytest.raises(Exception, match="must contain"):
        RN.score_run(bad, MANIFEST, MODEL, out, hist, "bad", source="s", ground_truth="")
    # rows of a run that stopped before its record are not read
    _rows(spark, 4).withColumn("prediction", F.lit(1.0)).write.parquet(f"{out}/run_id=broken")
    assert [r.id for r in RN.read_history(spark, hist).collect()] == ["good"]
    assert RN.read_predictions(spark, out, hist).count() == 3
    with pytest.raises(ValueError):
        RN.score_run(_rows(spark, 3), MANIFEST, MODEL, out, hist, "../up", source="s")


def test_a_replayed_stream_batch_counts_once(spark, tmp_dir):
    src, out, hist = (f"{tmp_dir}/{n}" for n in ("src", "out", "hist"))
    _rows(spark, 40).repartition(4).write.parquet(src)
    schema = _rows(spark, 1).schema
    for ck in ("one", "two"):                    # a lost checkpoint replays every batch
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        score_stream(stream, MANIFEST, MODEL, out, hist, f"{tmp_dir}/{ck}").awaitTermination()
    h = RN.read_history(spark, hist)
    assert h.count() == 4 and h.agg(F.sum("row_count")).first()[0] == 40
    assert RN.read_predictions(spark, out, hist).count() == 40


def test_a_training_run_is_read_whole_and_evaluated(spark, tmp_dir):
    spec = TrainSpec(features=["x"], target="y", algorithm="linear_regression", key_cols=["id"], cv_folds=3)
    with pytest.raises(ValueError, match="missing columns: x"):
        train(_rows(spark, 30), spec, test=_rows(spark, 5).drop("x"))
    res = train(_rows(spark, 30), spec, test=_rows(spark, 10, 100))
    assert res.test_metrics.first()["rmse"] == pytest.approx(0, abs=1e-6)
    record = RN.save_run(res, tmp_dir, "m1", "First", completed_at="2024-05-01T00:00:00+00:00")
    again = RN.save_run(res, tmp_dir, "m1", "Second")                       # replaces the first
    os.makedirs(f"{tmp_dir}/m2/model-x")                                      # an unfinished run
    rows = S.scan_trained_models(spark, tmp_dir).collect()
    assert [(r.id, r.name) for r in rows] == [("m1", "Second")] and again["settings"]["cv_folds"] == 3
    assert record["validation_metrics"]["r2"] == pytest.approx(1.0) and record["test_metrics"]["rmse"] == pytest.approx(0, abs=1e-6)
    manifest = S.scan_manifests(spark, tmp_dir).first()
    assert manifest.package_dir == "m1" and [f["name"] for f in manifest.features] == ["x"]
    shifted = _rows(spark, 10).withColumn("y", F.col("y") + 3)
    assert RN.evaluate_run(spark, tmp_dir, "m1", shifted)["rmse"] == pytest.approx(3.0)
    model, record = RN.load_run(spark, tmp_dir, "m1")
    assert record["test_rmse"] == pytest.approx(3.0) and record["name"] == "Second"
    assert model.transform(_rows(spark, 3)).filter("abs(prediction - y) > 1e-6").count() == 0


def test_streamed_job_states_equal_the_batch_fold(spark, tmp_dir):
    """Events out of order over many batches, a repeated batch, snapshots in between."""
    import random

    from tessera.operators import joblog as J
    from tessera.streaming.scoring import compact_job_state, job_state_stream, read_job_state
    rnd = random.Random(3)
    rows = [(rnd.randrange(40), i, rnd.choice(["queued", "running", "completed", "failed", None])) for i in range(600)]
    rnd.shuffle(rows)
    schema, src, out = "job_id long, seq long, state string", f"{tmp_dir}/src", f"{tmp_dir}/out"
    done = []
    for k in range(3):
        done += rows[200 * k:200 * k + 200]
        spark.createDataFrame(rows[200 * k:200 * k + 200], schema).repartition(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        job_state_stream(stream, out, f"{tmp_dir}/ck").awaitTermination()
        want = sorted(map(tuple, J.job_state(spark.createDataFrame(done, schema)).collect()))
        assert sorted(map(tuple, read_job_state(spark, out).collect())) == want
        if k == 1:
            # the last batch once more, as after a failure between its write and its commit
            last = max(int(n.split("=")[1]) for n in os.listdir(f"{out}/changes") if "=" in n)
            batch = spark.read.parquet(f"{out}/changes/batch_id={last}")
            spark.createDataFrame(batch.collect(), batch.schema).write.mode("overwrite").parquet(f"{out}/changes/batch_id={last}")
        compact_job_state(spark, out)
        assert sorted(map(tuple, read_job_state(spark, out).collect())) == want
