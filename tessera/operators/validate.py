"""Row-level validation and cleaning.

All row checks for one input are a single aggregate (``guard_counts``), never one job
per column; callers either read the guard row or let ``raise_guards`` fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col, is_missing, numeric_text
from tessera.operators.score import Manifest, keep_complete


def clean_required_rows(df: DataFrame, manifest: Manifest, ground_truth: str | None):
    """Drop rows missing any required feature or the ground truth (V8).

    Returns (kept rows, one-row DataFrame with rows_in, rows_kept, dropped_rows)."""
    keep = keep_complete(df, manifest, ground_truth)
    flagged = df.withColumn("_keep", keep)
    stats = flagged.agg(F.count(F.lit(1)).alias("rows_in"),
                        F.count_if(F.col("_keep")).alias("rows_kept")) \
        .withColumn("dropped_rows", F.col("rows_in") - F.col("rows_kept"))
    return flagged.filter(F.col("_keep")).drop("_keep"), stats


def project_features(df: DataFrame, manifest: Manifest) -> DataFrame:
    """Feature projection in manifest order."""
    return df.select(*[col(n) for n in manifest.feature_names])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows without a target cannot train or evaluate."""
    return df.filter(~is_missing(df, target))


def drop_null_features(df: DataFrame, features: list[str]) -> DataFrame:
    """V12 (numeric_imputer='drop'): drop rows missing any feature, categorical included."""
    cond = F.lit(True)
    for f in features:
        cond = cond & ~is_missing(df, f)
    return df.filter(cond)


def numeric_violation(df: DataFrame, name: str) -> Column:
    """A present value that does not parse as a number (text columns only)."""
    c = col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return c.isNotNull() & ~numeric_text(c)
    return F.lit(False)


def guard_counts(df: DataFrame, manifest: Manifest, ground_truth: str | None = None,
                 numeric_target: bool = False) -> DataFrame:
    """One aggregate with every row-level guard for a scoring or training input:
    rows_in (V2), rows_kept / dropped_rows (V8, V9), one ``bad_<feature>`` count per
    numeric feature (V3) and ``bad_target`` (V13)."""
    keep = keep_complete(df, manifest, ground_truth)
    aggs = [F.count(F.lit(1)).alias("rows_in"), F.count_if(keep).alias("rows_kept")]
    for f in manifest.features:
        if f.numeric and f.name in df.columns:
            aggs.append(F.count_if(numeric_violation(df, f.name)).alias(f"bad_{f.name}"))
    if ground_truth and numeric_target:
        aggs.append(F.count_if(numeric_violation(df, ground_truth)).alias("bad_target"))
    return df.agg(*aggs).withColumn("dropped_rows", F.col("rows_in") - F.col("rows_kept"))


def raise_guards(guards: DataFrame) -> DataFrame:
    """Fail inside the job when a guard is violated; returns the guard row otherwise."""
    cond = F.when(F.col("rows_in") == 0, F.raise_error(F.lit("input must contain at least one data row")))
    for c in guards.columns:
        if c.startswith("bad_"):
            cond = cond.when(F.col(c) > 0, F.raise_error(F.lit(f"column '{c[4:]}' has non-numeric values")))
    cond = cond.when(F.col("rows_kept") == 0, F.raise_error(F.lit("no rows left after dropping missing values")))
    return guards.withColumn("rows_kept", cond.otherwise(F.col("rows_kept")).cast("long"))


def cast_features(df: DataFrame, manifest: Manifest) -> DataFrame:
    """V4 per row: numeric text -> double; int dtypes truncate toward zero through double.
    An infinite value in an int feature is a violation (null here, counted by guards)."""
    from tessera.operators.score import coerce_features
    return coerce_features(df, manifest)


def training_guards(df: DataFrame, target: str, folds: int, classification: bool) -> DataFrame:
    """V16/V17 after all row removal: usable rows >= folds; for classification at least
    two classes and the smallest class >= folds. Class counts are one grouped aggregate
    (partial aggregation map-side, so a dominant class costs nothing extra)."""
    if classification:
        per_class = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("_n"))
        out = per_class.agg(F.sum("_n").cast("long").alias("usable_rows"),
                            F.count(F.lit(1)).cast("long").alias("n_classes"),
                            F.min("_n").cast("long").alias("min_class_count"))
    else:
        out = df.agg(F.count(F.lit(1)).cast("long").alias("usable_rows")) \
            .withColumn("n_classes", F.lit(None).cast("long")) \
            .withColumn("min_class_count", F.lit(None).cast("long"))
    ok = F.col("usable_rows") >= folds
    if classification:
        ok = ok & (F.col("n_classes") >= 2) & (F.col("min_class_count") >= folds)
    return out.withColumn("ok", ok)
