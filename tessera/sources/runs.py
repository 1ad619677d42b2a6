"""Records of training and scoring runs that a repeated or broken run cannot spoil.

Files are committed by name: a record is written under a temporary name and renamed over the final one in one
step, and what it stands for (model files, predictions) is written before it. Readers start from records,
so what an unfinished run left behind is never read, and writing a run again replaces its record.

    <root>/<model id>/model-<attempt>/...   fitted pipeline of one attempt
    <root>/<model id>/metadata.json         its manifest (S11)
    <root>/<model id>/record.json           settings, both metric maps, the name of the model folder (S13)

    <predictions>/run_id=<run>/part-...     predictions of a run
    <history>/<run>.json                    model id and name, source, row count, time (X10)
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.score import Manifest, ScoreResult, ValidationError, score
from tessera.operators.train import FittedPipeline, TrainResult, external_metrics
from tessera.sources.models import load_pipeline, save_pipeline

HISTORY = "id string, model_id string, model_name string, source_filename string, row_count long, created_at string"


# ------------------------------------------------------------------ files
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A JSON document at ``path``, whole or not at all; an older one is replaced in one step."""
    data = json.dumps(document, ensure_ascii=False, indent=2, default=float).encode()
    final, fs = _fs(spark, path)
    temp, _ = _fs(spark, f"{final.getParent()}/.{final.getName()}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(final.getParent())
    out = fs.create(temp, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where = fs.makeQualified(final).toUri()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(temp), fs.makeQualified(final), options)


def read_document(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path, wholetext=True).first()
    if row is None:
        raise ValidationError(f"no record at {path}")
    return json.loads(row[0])


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


# ------------------------------------------------------------------ training runs
def _metric_map(metrics: DataFrame | None) -> dict | None:
    return None if metrics is None else metrics.first().asDict()                    # one row


def manifest_of(model_id: str, name: str, model: FittedPipeline) -> dict:
    spec = model.spec
    kinds = {**{c: "float64" for c in model.numeric}, **{c: "string" for c in model.categorical}}
    return {"id": model_id, "name": name, "version": "1.0.0", "framework": "spark", "problem_type": spec.problem_type, "target": spec.target,
            "features": [{"name": c, "dtype": kinds[c], "required": False} for c in spec.features], "prediction_column": "prediction"}


def save_run(result: TrainResult, root: str, model_id: str, name: str, *, completed_at: str | None = None) -> dict:
    """Write a training run under ``root``/``model_id`` and return its record. Until the record is in place the
    run does not exist; a second run under the same id replaces it."""
    model, spec = result.model, result.model.spec
    spark = result.metrics.sparkSession
    folder = f"{root}/{model_id}"
    attempt = f"model-{uuid.uuid4().hex[:12]}"
    save_pipeline(model, f"{folder}/{attempt}", spark)
    validation, test = _metric_map(result.metrics), _metric_map(result.test_metrics)
    manifest = manifest_of(model_id, name, model)
    record = {"id": model_id, "name": name, "completed_at": completed_at or _now(), "target_column": spec.target, "algorithm": spec.algorithm,
              "problem_type": spec.problem_type, "status": "draft", "feature_columns": list(spec.features), "settings": asdict(spec),
              "validation_metrics": validation, "validation_rmse": validation.get("rmse"), "validation_r2": validation.get("r2"),
              **_test_fields(test), "manifest": manifest, "model_folder": attempt}
    write_document(spark, f"{folder}/metadata.json", manifest)
    write_document(spark, f"{folder}/record.json", record)
    return record


def _test_fields(test: dict | None) -> dict:
    return {"test_metrics": test, "test_rmse": test.get("rmse") if test else None, "test_r2": test.get("r2") if test else None}


def load_run(spark: SparkSession, root: str, model_id: str) -> tuple[FittedPipeline, dict]:
    record = read_document(spark, f"{root}/{model_id}/record.json")
    return load_pipeline(f"{root}/{model_id}/{record['model_folder']}", spark), record


def evaluate_run(spark: SparkSession, root: str, model_id: str, test: DataFrame) -> dict:
    """Metrics of a stored model on another table, written back to its record."""
    model, record = load_run(spark, root, model_id)
    metrics = _metric_map(external_metrics(model, test))
    write_document(spark, f"{root}/{model_id}/record.json", {**record, **_test_fields(metrics)})
    return metrics


# ------------------------------------------------------------------ scoring runs
def _name(run_id: str) -> str:
    if not run_id or not all(c.isalnum() or c in "-_." for c in run_id) or run_id.startswith("."):
        raise ValueError("a run id holds letters, digits, '-', '_' and '.' only")
    return run_id


def write_history(spark: SparkSession, history: str, run_id: str, model_id: str, model_name: str, source: str, row_count: int,
                  created_at: str | None = None) -> None:
    """The row of a run; writing it again replaces it."""
    write_document(spark, f"{history}/{_name(run_id)}.json", {
        "id": run_id, "model_id": model_id, "model_name": model_name, "source_filename": source.replace("\\", "/").rsplit("/", 1)[-1],
        "row_count": row_count, "created_at": created_at or _now()})


def read_history(spark: SparkSession, history: str) -> DataFrame:
    """One row per run that ended well."""
    return spark.read.schema(HISTORY).option("multiLine", True).option("pathGlobFilter", "[!.]*.json").json(history)


def score_run(df: DataFrame, manifest: Manifest, model, predictions: str, history: str, run_id: str, *, source: str,
              ground_truth: str | None = None, created_at: str | None = None, allow_empty: bool = False) -> ScoreResult:
    """Score ``df`` into the folder of ``run_id`` and, once that is written, add the run's history row. The rows are
    counted while they are written. A run that fails writes no history; one that is repeated replaces
    its rows and its history row."""
    spark = df.sparkSession
    result = score(df, manifest, model, ground_truth=ground_truth, allow_empty=allow_empty)
    seen = Observation()
    result.predictions.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{predictions}/run_id={_name(run_id)}")
    rows = seen.get["rows"]
    if rows:
        write_history(spark, history, run_id, manifest.id, manifest.name, source, rows, created_at)
    return result


def read_predictions(spark: SparkSession, predictions: str, history: str) -> DataFrame:
    """Rows of the runs that the history names, with ``run_id`` (text)."""
    from tessera.session import sql_conf
    with sql_conf(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        rows = spark.read.parquet(predictions)
    return rows.join(read_history(spark, history).select(F.col("id").alias("run_id")), "run_id", "left_semi")
