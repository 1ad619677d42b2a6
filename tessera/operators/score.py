"""Batch scoring: validate -> coerce -> drop incomplete rows -> predict -> decorate,
with guards and metrics from the same plan.

The logical plan is scan -> project(coerce) -> filter -> model -> project; the
guards ride inside the metric aggregate as ``raise_error`` so no extra job runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col, is_missing, numeric_text
from tessera.operators import metrics as M


class ValidationError(ValueError):
    """Input does not satisfy the model contract."""


NO_ROWS, NONE_LEFT = "input must contain at least one data row", "no rows left after dropping missing values"


# ---------------------------------------------------------------- model contract

@dataclass(frozen=True)
class FeatureSpec:
    name: str
    dtype: str = "float64"
    required: bool = True

    @property
    def numeric(self) -> bool:
        return self.dtype.startswith(("float", "int"))

    @property
    def spark_type(self) -> str:
        if self.dtype.startswith("int"):
            return "bigint"
        if self.dtype.startswith("float"):
            return "double"
        if self.dtype.startswith("bool"):
            return "boolean"
        return "string"


CLASSIFICATION_TYPES = ("classification", "binary_classification", "multiclass_classification")


@dataclass(frozen=True)
class Manifest:
    id: str
    name: str
    features: tuple[FeatureSpec, ...]
    problem_type: str = "regression"
    target: str | None = None
    framework: str = "spark"
    prediction_column: str = "prediction"
    version: str = "1.0.0"

    @property
    def is_classification(self) -> bool:
        return self.problem_type.lower() in CLASSIFICATION_TYPES

    @property
    def feature_names(self) -> list[str]:
        return [f.name for f in self.features]


@dataclass(frozen=True)
class LinearModel:
    """y = intercept + sum(coef * x); ``link='logistic'`` gives P(second class)."""
    intercept: float
    coefficients: dict[str, float]
    link: str = "identity"
    classes: tuple[str, ...] = ()
    threshold: float = 0.5

    def margin(self) -> Column:
        z = F.lit(float(self.intercept))
        for name, w in self.coefficients.items():
            z = z + F.lit(float(w)) * col(name).cast("double")
        return z

    def predict(self) -> Column:
        if self.link == "logistic":
            prob = self.probability()
            lo, hi = self.classes or ("0", "1")
            return F.when(prob > F.lit(self.threshold), F.lit(hi)).otherwise(F.lit(lo))
        return self.margin()

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


@dataclass
class ScoreResult:
    predictions: DataFrame
    metrics: DataFrame | None      # rows, dropped_rows and the metrics (None without ground truth)
    ground_truth: str | None
    guards: DataFrame | None = None    # rows, dropped_rows; reading it raises if a guard fails


# ---------------------------------------------------------------- validation steps

def missing_required(df: DataFrame, manifest: Manifest) -> list[str]:
    """Required feature columns absent from the input (schema check, no job)."""
    have = set(df.columns)
    return [f.name for f in manifest.features if f.required and f.name not in have]


def add_absent_optional(df: DataFrame, manifest: Manifest) -> DataFrame:
    """An optional feature absent from the input is added as null (the imputer decides)."""
    for f in manifest.features:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.spark_type))
    return df


def coercion_violation(df: DataFrame, f: FeatureSpec) -> Column:
    """True for a present value of a numeric feature that does not parse as a number."""
    c = col(f.name)
    if isinstance(df.schema[f.name].dataType, T.StringType):
        return c.isNotNull() & ~numeric_text(c)
    return F.lit(False)


def coerce_features(df: DataFrame, manifest: Manifest) -> DataFrame:
    """Cast numeric features to the manifest dtype per row; integers go through double and
    truncate toward zero (1.7 -> 1). Non-feature columns pass through untouched."""
    feats = {f.name: f for f in manifest.features}
    out = []
    for name in df.columns:
        f = feats.get(name)
        if f is not None and f.numeric:
            src = df.schema[name].dataType
            d = (F.trim(col(name)).try_cast("double") if isinstance(src, T.StringType)
                 else col(name).cast("double"))
            out.append((d.cast("bigint") if f.spark_type == "bigint" else d).alias(name))
        else:
            out.append(col(name))
    return df.select(*out)


def resolve_ground_truth(df: DataFrame, manifest: Manifest, ground_truth: str | None) -> str | None:
    """'' disables evaluation; a given name is used; otherwise the manifest target if the
    input carries it. The result must not be a feature and must exist."""
    if ground_truth == "":
        return None
    chosen = ground_truth or (manifest.target if manifest.target in df.columns else None)
    if chosen and chosen in manifest.feature_names:
        raise ValidationError("ground truth column must not be a model feature")
    if chosen and chosen not in df.columns:
        raise ValidationError(f"ground truth column not found: {chosen}")
    return chosen


def keep_complete(df: DataFrame, manifest: Manifest, ground_truth: str | None) -> Column:
    """Row predicate: every required feature and the ground truth are present."""
    needed = [f.name for f in manifest.features if f.required] + ([ground_truth] if ground_truth else [])
    cond = F.lit(True)
    for n in needed:
        cond = cond & ~is_missing(df, n)
    return cond


# ---------------------------------------------------------------- scoring

def score(df: DataFrame, manifest: Manifest, model, ground_truth: str | None = None,
          validate_schema: bool = True, allow_empty: bool = False) -> ScoreResult:
    """Score ``df`` with ``model`` (a LinearModel, a tree ensemble with ``predict()`` column,
    or a fitted Spark ML PipelineModel). Returns predictions (input columns + prediction
    [+ prediction_error | prediction_correct]; reading them raises on an input without rows or
    without a complete row, unless ``allow_empty``) and, with a ground truth, the metrics row
    including ``rows`` and ``dropped_rows``."""
    if validate_schema:
        gone = missing_required(df, manifest)
        if gone:
            raise ValidationError("input is missing required columns: " + ", ".join(gone))
    df = add_absent_optional(df, manifest)
    gt = resolve_ground_truth(df, manifest, ground_truth)

    flags = {f"__score_bad_{i}": coercion_violation(df, f) for i, f in enumerate(manifest.features) if f.numeric}
    bad = [F.count_if(F.col(n)).alias(n) for n in flags]
    typed = coerce_features(df.select("*", *[c.alias(n) for n, c in flags.items()]), manifest)
    keep = keep_complete(typed, manifest, gt)
    flagged = typed.withColumn("__score_keep", keep)
    # a present value that does not parse stops the run, with or without a ground truth
    refuse = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for i, f in enumerate(manifest.features):
        if f.numeric:
            refuse = refuse.when(F.col(f"__score_bad_{i}"), F.raise_error(F.lit(f"column '{f.name}' must contain {f.dtype} values")).cast("boolean"))
    kept = flagged.filter(refuse.otherwise(F.col("__score_keep"))).drop("__score_keep", *flags)

    pred_name = manifest.prediction_column
    if hasattr(model, "transform"):
        raw = model.transform(kept).withColumnRenamed("prediction", "_raw_pred")
    else:
        raw = kept.withColumn("_raw_pred", model.predict())
    if manifest.is_classification:
        out = raw.withColumn(pred_name, F.col("_raw_pred").cast("string"))
        if gt:
            truth, guess = col(gt).cast("string"), F.col("_raw_pred").cast("string")
            if isinstance(out.schema["_raw_pred"].dataType, T.NumericType):      # 1.0 and 1 are the same class
                truth, guess = (c.try_cast("double").cast("string") for c in (truth, guess))
            out = out.withColumn("prediction_correct", F.coalesce(guess == truth, F.lit(False)))
    else:
        out = raw.withColumn(pred_name, F.round(F.col("_raw_pred").cast("double"), 4))
        if gt:
            out = out.withColumn("prediction_error",
                                 F.round(F.col("_raw_pred").cast("double") - col(gt).cast("double"), 4))

    metrics = None
    if gt and not manifest.is_classification and not hasattr(model, "transform"):
        # expression models: guards and metrics in one aggregate over one scan, the
        # metric terms masked to the kept rows
        yv, pv = col(gt).cast("double"), model.predict().cast("double")
        one = flagged.agg(F.count(F.lit(1)).alias("_rows_in"), F.count_if(F.col("__score_keep")).alias("_rows"), *bad,
                          *M.regression_terms(yv, pv, mask=F.col("__score_keep")))
        metrics = _guard_columns(one, manifest).select("rows", "dropped_rows", *M.regression_columns())
    elif gt:
        guards = [F.count(F.lit(1)).alias("_rows_in"), F.count_if(F.col("__score_keep")).alias("_rows")] + bad
        guard_row = flagged.agg(*guards)
        if manifest.is_classification:
            m = M.classification_metrics(out.withColumns({"_act": truth, "_guess": guess}), "_act", "_guess")
        else:
            m = raw.agg(*M.regression_terms(col(gt).cast("double"), F.col("_raw_pred").cast("double"))) \
                .select(*M.regression_columns())
        metrics = _attach_guards(m, guard_row, manifest)
    own = set(df.columns)
    keep_cols = [c for c in out.columns if c in own or not c.startswith("_")]
    guard_row = flagged.agg(F.count(F.lit(1)).alias("_rows_in"), F.count_if(F.col("__score_keep")).alias("_rows"), *bad)
    guards = _guard_columns(guard_row, manifest).select("rows", "dropped_rows")
    predictions = out.select(*[col(c) for c in keep_cols])
    return ScoreResult(predictions if allow_empty else _stop_if_empty(predictions, flagged), metrics, gt, guards)


def _stop_if_empty(predictions: DataFrame, flagged: DataFrame) -> DataFrame:
    """``predictions``, raising when they are read if the input has no row or no complete one. The branch that
    looks takes one row of each kind and adds none."""
    found = flagged.select(F.lit(False).alias("kept")).limit(1).unionByName(
        flagged.filter("__score_keep").select(F.lit(True).alias("kept")).limit(1))
    seen = found.agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"))
    stop = (F.when(F.col("n") == 0, F.raise_error(F.lit(NO_ROWS)).cast("boolean"))
            .when(F.col("kept") == 0, F.raise_error(F.lit(NONE_LEFT)).cast("boolean")).otherwise(F.lit(False)))
    return predictions.unionByName(seen.filter(stop).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in predictions.schema.fields]))


def _guard_columns(row: DataFrame, manifest: Manifest) -> DataFrame:
    """rows (raising inside the job when a guard fails) and dropped_rows from the guard counts."""
    checks = F.when(F.col("_rows_in") == 0, F.raise_error(F.lit(NO_ROWS)))
    for i, f in enumerate(manifest.features):
        if f.numeric:
            checks = checks.when(F.col(f"__score_bad_{i}") > 0,
                                 F.raise_error(F.lit(f"column '{f.name}' must contain {f.dtype} values")))
    checks = checks.when(F.col("_rows") == 0, F.raise_error(F.lit(NONE_LEFT)))
    return row.withColumn("rows", checks.otherwise(F.col("_rows")).cast("long")) \
        .withColumn("dropped_rows", (F.col("_rows_in") - F.col("_rows")).cast("long"))


def _attach_guards(metrics: DataFrame, guard_row: DataFrame, manifest: Manifest) -> DataFrame:
    """Both inputs are single-row aggregates; they are stacked through one union and
    folded by one aggregate (no join). A failed guard raises inside the job through the
    ``rows`` column, which every caller keeps."""
    checks = F.when(F.col("_rows_in") == 0, F.raise_error(F.lit(NO_ROWS)))
    for i, f in enumerate(manifest.features):
        if f.numeric:
            checks = checks.when(F.col(f"__score_bad_{i}") > 0,
                                 F.raise_error(F.lit(f"column '{f.name}' must contain {f.dtype} values")))
    checks = checks.when(F.col("_rows") == 0, F.raise_error(F.lit(NONE_LEFT)))
    g = guard_row.select(checks.otherwise(F.col("_rows")).cast("long").alias("rows"),
                         (F.col("_rows_in") - F.col("_rows")).cast("long").alias("dropped_rows"))
    mcols = metrics.columns
    left = metrics.select(*[F.col(c) for c in mcols], F.lit(None).cast("long").alias("rows"),
                          F.lit(None).cast("long").alias("dropped_rows"))
    right = g.select(*[F.lit(None).cast(metrics.schema[c].dataType).alias(c) for c in mcols],
                     "rows", "dropped_rows")
    return left.unionByName(right).agg(F.max("rows").alias("rows"), F.max("dropped_rows").alias("dropped_rows"),
                                       *[F.max(c).alias(c) for c in mcols])


def score_by_model_table(rows: DataFrame, models: DataFrame, feature: str,
                         model_key: str = "model_id") -> DataFrame:
    """Score rows that carry a model id against a table of linear models
    (model_id, intercept, slope, framework). Rows naming an unknown model or a model
    whose framework is not supported are kept with a reject status and no prediction.

    The model table is joined without a hint: AQE broadcasts it at run time when its
    measured size is under the threshold and falls back to a shuffle join otherwise."""
    m = models.select(col(model_key), "intercept", "slope", "framework", F.lit(True).alias("_known"))
    j = rows.join(m, model_key, "left")
    ok = F.lower(F.col("framework")) == F.lit("spark")
    status = (F.when(F.col("_known").isNull(), F.lit("unknown_model"))
              .when(~ok, F.lit("unsupported_framework")).otherwise(F.lit("scored")))
    pred = F.when(F.col("_known").isNotNull() & ok,
                  F.round(F.col("intercept") + F.col("slope") * col(feature).cast("double"), 4))
    return j.withColumn("status", status).withColumn("prediction", pred) \
        .drop("intercept", "slope", "framework", "_known")
