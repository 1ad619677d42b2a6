"""Model-quality metrics as aggregations over (actual, predicted) columns.

Every metric is rounded to 6 decimals at the end, from full-precision aggregates.
Regression metrics are one aggregate; classification metrics first reduce to the
confusion counts (size <= classes^2), so the second stage is tiny whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import MAPE_EPSILON, col
from tessera.operators.ranking import range_running_sum

ROUND = 6


def _safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def regression_terms(y: Column, p: Column, mask: Column | None = None) -> list[Column]:
    """Partial aggregates from which every regression metric is derived. With ``mask``,
    only rows where it holds count (so one aggregate can also carry other counts)."""
    if mask is not None:
        y, p = F.when(mask, y), F.when(mask, p)
    e = p - y
    return [
        F.count(e).alias("_n"),
        F.avg(F.abs(e)).alias("_mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(MAPE_EPSILON))).alias("_mape"),
        F.avg(e * e).alias("_mse"),
        F.max(F.abs(e)).alias("_max_err"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(y).alias("_var_y"),
        F.covar_pop(y, p).alias("_cov"),
        F.stddev_pop(y).alias("_sd_y"),
        F.stddev_pop(p).alias("_sd_p"),
        F.avg(y).alias("_mean_y"),
        F.min(y).alias("_min_y"),
        F.max(y).alias("_max_y"),
    ]


def r2_from(sse: Column, var_y: Column, n: Column) -> Column:
    sst = var_y * n
    return (F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - _safe_div(sse, sst)))


def pearson_from(cov: Column, sd_y: Column, sd_p: Column) -> Column:
    return F.coalesce(_safe_div(cov, sd_y * sd_p), F.lit(0.0))


def regression_columns(prefix: str = "", external: bool = False) -> list[Column]:
    """Final metric columns over a row of ``regression_terms``."""
    out = [
        F.round(F.col("_mae"), ROUND).alias(f"{prefix}mae"),
        F.round(F.lit(100.0) * F.col("_mape"), ROUND).alias(f"{prefix}mape"),
        F.round(F.sqrt(F.col("_mse")), ROUND).alias(f"{prefix}rmse"),
        F.round(F.col("_max_err"), ROUND).alias(f"{prefix}max_error"),
        F.round(r2_from(F.col("_sse"), F.col("_var_y"), F.col("_n")), ROUND).alias(f"{prefix}r2"),
        F.round(pearson_from(F.col("_cov"), F.col("_sd_y"), F.col("_sd_p")), ROUND).alias(f"{prefix}pearson_r"),
    ]
    if external:
        rng = F.col("_max_y") - F.col("_min_y")
        out += [
            F.round(F.when(rng == 0, F.lit(0.0)).otherwise(_safe_div(F.sqrt(F.col("_mse")), rng)), ROUND)
            .alias(f"{prefix}nrmse"),
            F.round(F.col("_mean_y"), ROUND).alias(f"{prefix}target_mean"),
        ]
    return out


def regression_metrics(df: DataFrame, actual: str, predicted: str, external: bool = False,
                       group_by: list[str] | None = None) -> DataFrame:
    """mae, mape (%), rmse, max_error, r2, pearson_r [+ nrmse, target_mean]."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    g = group_by or []
    agg = (df.groupBy(*g) if g else df).agg(*regression_terms(y, p))
    return agg.select(*[col(c) for c in g], *regression_columns(external=external))


# --------------------------------------------------------------------------- classes

def confusion_counts(df: DataFrame, actual: str, predicted: str,
                     group_by: list[str] | None = None) -> DataFrame:
    g = group_by or []
    return (df.select(*[col(c) for c in g], col(actual).cast("string").alias("_y"),
                      col(predicted).cast("string").alias("_p"))
            .groupBy(*g, "_y", "_p").agg(F.count(F.lit(1)).alias("_n")))


def _per_class(conf: DataFrame, g: list[str]) -> DataFrame:
    # each confusion cell contributes to its actual class (support), its predicted
    # class (predicted count) and, on the diagonal, to true positives
    roles = F.explode(F.array(
        F.struct(F.col("_y").alias("_c"), F.col("_n").alias("_support"), F.lit(0).cast("long").alias("_pred"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).cast("long").alias("_tp")),
        F.struct(F.col("_p").alias("_c"), F.lit(0).cast("long").alias("_support"), F.col("_n").alias("_pred"),
                 F.lit(0).cast("long").alias("_tp")),
    ))
    return (conf.select(*[col(c) for c in g], roles.alias("_r"))
            .groupBy(*g, "_r._c").agg(F.sum("_r._support").alias("support"),
                                      F.sum("_r._pred").alias("pred"),
                                      F.sum("_r._tp").alias("tp")))


def classification_metrics(df: DataFrame, actual: str, predicted: str,
                           group_by: list[str] | None = None, rounded: bool = True) -> DataFrame:
    """accuracy and support-weighted precision / recall / F1 (zero division -> 0)."""
    g = group_by or []
    per = _per_class(confusion_counts(df, actual, predicted, g), g)
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("pred")), F.lit(0.0))
    agg = (per.groupBy(*g) if g else per).agg(
        F.sum("support").alias("_total"), F.sum("tp").alias("_tp"),
        F.sum(prec * F.col("support")).alias("_wp"), F.sum(rec * F.col("support")).alias("_wr"),
        F.sum(f1 * F.col("support")).alias("_wf"))
    r = (lambda c: F.round(c, ROUND)) if rounded else (lambda c: c)
    return agg.select(
        *[col(c) for c in g],
        r(F.col("_tp") / F.col("_total")).alias("accuracy"),
        r(F.col("_wp") / F.col("_total")).alias("precision"),
        r(F.col("_wr") / F.col("_total")).alias("recall"),
        r(F.col("_wf") / F.col("_total")).alias("f1"),
    )


# --------------------------------------------------------------------------- CV

def cv_regression_metrics(oof: DataFrame, fold: str, actual: str, predicted: str) -> DataFrame:
    """Mean of per-fold rmse/mae/r2, population std of fold rmse; pooled pearson,
    mape, max error and target mean over the out-of-fold rows.

    One ``rollup(fold)`` aggregate yields the per-fold rows and the pooled row together."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    both = (oof.rollup(col(fold)).agg(*regression_terms(y, p), F.grouping_id().alias("_gid"))
            .select("_gid", F.sqrt("_mse").alias("_rmse"), F.col("_mae"),
                    r2_from(F.col("_sse"), F.col("_var_y"), F.col("_n")).alias("_r2"),
                    F.col("_mape"), F.col("_max_err"), F.col("_mean_y"),
                    pearson_from(F.col("_cov"), F.col("_sd_y"), F.col("_sd_p")).alias("_pr")))
    per_fold = F.col("_gid") == 0
    pooled = F.col("_gid") == 1
    return both.agg(
        F.round(F.avg(F.when(per_fold, F.col("_rmse"))), ROUND).alias("rmse"),
        F.round(F.stddev_pop(F.when(per_fold, F.col("_rmse"))), ROUND).alias("rmse_std"),
        F.round(F.avg(F.when(per_fold, F.col("_mae"))), ROUND).alias("mae"),
        F.round(F.avg(F.when(per_fold, F.col("_r2"))), ROUND).alias("r2"),
        F.round(F.lit(100.0) * F.max(F.when(pooled, F.col("_mape"))), ROUND).alias("mape"),
        F.round(F.max(F.when(pooled, F.col("_max_err"))), ROUND).alias("max_error"),
        F.round(F.max(F.when(pooled, F.col("_pr"))), ROUND).alias("pearson_r"),
        F.round(F.max(F.when(pooled, F.col("_mean_y"))), ROUND).alias("target_mean"),
    )


def cv_classification_metrics(oof: DataFrame, fold: str, actual: str, predicted: str) -> DataFrame:
    per_fold = classification_metrics(oof, actual, predicted, group_by=[fold], rounded=False)
    return per_fold.agg(*[F.round(F.avg(m), ROUND).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


# --------------------------------------------------------------------------- ROC AUC

def roc_auc(df: DataFrame, label: str, score: str, positive: Column | None = None) -> DataFrame:
    """Exact ROC AUC by the rank-sum rule with tied scores sharing their average rank.

    Rows first collapse to distinct scores (positive/negative counts), so copies of
    one score cost nothing downstream; the running count of negatives below each
    score comes from running sums over ranges of scores (no one-partition window)."""
    pos = positive if positive is not None else (col(label) == F.lit(1))
    by_score = (df.select(col(score).cast("double").alias("_s"), pos.cast("long").alias("_pos"))
                .groupBy("_s").agg(F.sum("_pos").alias("_p"), F.count(F.lit(1)).alias("_c"))
                .withColumn("_q", F.col("_c") - F.col("_p")))
    run = range_running_sum(by_score, ["_s"], {"_neg_le": F.col("_q")})
    # negatives strictly below = running inclusive count minus this score's negatives
    return run.agg(
        F.sum(F.col("_p") * (F.col("_neg_le") - F.col("_q") + F.col("_q") * 0.5)).alias("_num"),
        F.sum("_p").alias("_P"), F.sum("_q").alias("_N"),
    ).select(F.round(F.try_divide(F.col("_num"), F.col("_P").cast("double") * F.col("_N").cast("double")), ROUND).alias("roc_auc"))
