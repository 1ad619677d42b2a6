"""Scoring rows against a table of models (X8, X9): each row names its model.

A model is a row: family and parameters, features in order, and a leading preprocessing step (fill and scale per
feature). Rows carry their inputs by name, so models of one table may have different features.

    model_id, framework, family ('linear', 'logistic', 'trees'), features, fill, shift, scale, weights, intercept, classes, trees

Rows meet their model in a cogroup by model id and part: a model named by many rows is dealt over
parts of about ``PART_ROWS`` rows by a hash of the row's key, each with a copy of the model, so no task holds all
rows of a hot model. Within a part prediction is array work. Rows that cannot be scored go to a table of
rejects with the reason; nothing is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path, ship

PART_ROWS = 200_000
FRAMEWORKS = ("spark", "sklearn")
FAMILIES = ("linear", "logistic", "trees")
TREES = "struct<feat: array<int>, thr: array<double>, left: array<int>, right: array<int>, value: array<double>, roots: array<int>>"
MODELS = ("model_id string, framework string, family string, features array<string>, fill array<double>, shift array<double>, scale array<double>, "
          f"weights array<double>, intercept double, classes array<string>, trees {TREES}")
_OUT = "key long, model_id string, prediction double, label string, reason string"


@dataclass
class Scored:
    predictions: DataFrame       # key, model_id, prediction, label (classes only)
    rejects: DataFrame           # key, model_id, reason


def _numbers(values, n: int, default: float) -> np.ndarray:
    if not values:
        return np.full(n, default)
    return np.asarray([np.nan if v is None else v for v in values], np.float64)


def _walk(trees: dict, x: np.ndarray) -> np.ndarray:
    """Sum of the leaves reached: rows go left where the value is at most the threshold, missing values go right."""
    feat, thr, left, right, value = (np.asarray(trees[k]) for k in ("feat", "thr", "left", "right", "value"))
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for root in trees["roots"]:
        at = np.full(len(x), root)
        while (feat[at] >= 0).any():
            f = np.maximum(feat[at], 0)
            step = np.where(x[rows, f] <= thr[at], left[at], right[at])
            at = np.where(feat[at] >= 0, step, at)
        total += value[at]
    return total


def _reject_reason(model: dict) -> str | None:
    """Why a model cannot score any row."""
    if (model["framework"] or "").lower() not in FRAMEWORKS:
        return "unsupported_framework"
    family, n = (model["family"] or "").lower(), len(model["features"] or ())
    if family not in FAMILIES:
        return "unsupported_family"
    sizes = [len(model[k]) for k in ("fill", "shift", "scale") if model[k]]
    if family != "trees":
        sizes.append(len(model["weights"] or ()))
    elif not model["trees"] or not model["trees"]["roots"] or max(model["trees"]["feat"]) >= n:
        return "broken_model"
    if not n or any(s != n for s in sizes) or (family == "logistic" and len(model["classes"] or ("0", "1")) != 2):
        return "broken_model"
    return None


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predictions, missing): x has a column per feature, NaN where a value is absent; a row is missing where one
    stays absent after the fill (trees take missing values as they are)."""
    n = x.shape[1]
    x = np.where(np.isnan(x), _numbers(model["fill"], n, np.nan), x)
    gone = np.isnan(x).any(1) if model["family"].lower() != "trees" else np.zeros(len(x), bool)
    x = (x - _numbers(model["shift"], n, 0.0)) / _numbers(model["scale"], n, 1.0)
    if model["family"].lower() == "trees":
        return _walk(model["trees"], x) + (model["intercept"] or 0.0), gone
    z = np.full(len(x), model["intercept"] or 0.0)
    for i, w in enumerate(model["weights"]):             # in the features' order: the same sum in any batch
        z = z + w * x[:, i]
    if model["family"].lower() == "logistic":
        z = 1.0 / (1.0 + np.exp(-z))
    return z, gone


def _score(models: pa.Table, rows: pa.Table) -> pa.Table:
    keys, ids = rows.column("key").to_pylist(), rows.column("row_model").to_pylist()
    n = len(keys)

    def out(prediction, label, reason) -> pa.Table:
        return pa.table({"key": pa.array(keys, pa.int64()), "model_id": pa.array(ids, pa.string()), "prediction": pa.array(prediction, pa.float64()),
                         "label": pa.array(label, pa.string()), "reason": pa.array(reason, pa.string())})

    if not n:
        return out([], [], [])
    if models.num_rows != 1:
        reason = "ambiguous_model" if models.num_rows else "unknown_model"
        return out([None] * n, [None] * n, [reason] * n)
    model = models.to_pylist()[0]
    reason = _reject_reason(model)
    if reason:
        return out([None] * n, [None] * n, [reason] * n)
    column = {f: i for i, f in enumerate(model["features"])}
    x = np.full((n, len(column)), np.nan)
    for i, inputs in enumerate(rows.column("inputs").to_pylist()):
        for name, value in inputs or ():
            if name in column and value is not None:
                x[i, column[name]] = value
    z, gone = predict(model, x)
    classes = model["classes"] or (["0", "1"] if model["family"].lower() == "logistic" else None)
    label = [None] * n if not classes else [None if g else classes[int(p > 0.5)] for p, g in zip(z, gone)]
    return out([None if g else float(p) for p, g in zip(z, gone)], label, ["missing_feature" if g else None for g in gone])


def score_by_manifest(rows: DataFrame, models: DataFrame, *, key: str, model_col: str = "model_id", inputs: str = "inputs",
                      part_rows: int = PART_ROWS) -> Scored:
    """Score ``rows`` (key: long; inputs: map of text to double) with the ``models`` (``MODELS``; absent columns count as
    null) they name. A null or unknown model id, an id that several models have, a model that cannot score and a row with a
    missing value are rejects."""
    spark = rows.sparkSession
    ship(spark)
    fields = [f.strip().rsplit(" ", 1) for f in MODELS.split(f", trees {TREES}")[0].split(", ")] + [["trees", TREES]]
    full = models.select(*[(F.col(n) if n in models.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
    named = rows.select(F.col(key).cast("long").alias("key"), F.col(model_col).cast("string").alias("row_model"), F.col(inputs).alias("inputs"),
                        F.monotonically_increasing_id().alias("place"))
    # parts per model: a row per model that is named
    parts = named.groupBy(F.col("row_model").alias("named_model")).agg(F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("parts"))
    path = scratch_path(spark, "model-parts")
    parts.write.parquet(path)
    parts = spark.read.schema("named_model string, parts int").parquet(path)
    dealt = named.join(parts, F.col("row_model").eqNullSafe(F.col("named_model")), "left").select(
        "key", "row_model", "inputs", F.pmod(F.xxhash64("key", "place"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    copies = full.join(parts, F.col("model_id") == F.col("named_model")).drop("named_model").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    path = scratch_path(spark, "model-scores")
    copies.groupBy("model_id", "part").cogroup(dealt.groupBy("row_model", "part")).applyInArrow(_score, _OUT).write.parquet(path)
    scored = spark.read.schema(_OUT).parquet(path)
    return Scored(scored.filter("reason is null").drop("reason"), scored.filter("reason is not null").select("key", "model_id", "reason"))
