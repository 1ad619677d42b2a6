"""Ordinary least squares from sufficient statistics.

One aggregate collects counts, means and centred sums (per group when given); the
fit is closed-form on that tiny table. Out-of-fold fits use complement statistics
(total minus the fold), so k folds cost one pass, not k fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col


def _suff(x, y):
    """Count, means and centred sums (they merge without cancellation)."""
    return [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
            F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy")]


def ols_fit(df: DataFrame, feature: str, target: str) -> DataFrame:
    """One row: slope, intercept, n (rows with both values present)."""
    x, y = col(feature).cast("double"), col(target).cast("double")
    return df.filter(x.isNotNull() & y.isNotNull()).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def oof_ols(df: DataFrame, feature: str, target: str, fold: str) -> DataFrame:
    """Out-of-fold predictions: each row scored by the fit on all other folds.

    Per-fold statistics are one grouped aggregate (k rows); complements are total minus
    fold over that k-row table, and the k fits are broadcast back by fold (a table whose
    size is the fold count)."""
    x, y = col(feature).cast("double"), col(target).cast("double")
    usable = df.filter(x.isNotNull() & y.isNotNull())
    per = usable.groupBy(col(fold)).agg(*_suff(x, y))
    everything = Window.partitionBy()  # over the k-row fold table only
    # totals from the folds' centred moments, then the complement of each fold
    total = per.withColumns({"all_n": F.sum("n").over(everything), "all_mx": F.sum(F.col("n") * F.col("mx")).over(everything),
                             "all_my": F.sum(F.col("n") * F.col("my")).over(everything)})
    total = total.withColumns({"all_mx": F.col("all_mx") / F.col("all_n"), "all_my": F.col("all_my") / F.col("all_n")})
    dx, dy = F.col("mx") - F.col("all_mx"), F.col("my") - F.col("all_my")
    total = total.withColumns({"all_sxx": F.sum(F.col("sxx") + F.col("n") * dx * dx).over(everything),
                               "all_sxy": F.sum(F.col("sxy") + F.col("n") * dx * dy).over(everything)})
    rest = F.col("all_n") - F.col("n")
    shift = F.try_divide(F.col("n") * F.col("all_n"), rest)      # distance of the fold from its complement, squared and weighed
    sxx, sxy = F.col("all_sxx") - F.col("sxx") - shift * dx * dx, F.col("all_sxy") - F.col("sxy") - shift * dx * dy
    slope = F.try_divide(sxy, F.when(sxx > 0, sxx))
    cx, cy = F.col("all_mx") - F.try_divide(F.col("n") * dx, rest), F.col("all_my") - F.try_divide(F.col("n") * dy, rest)
    fits = total.select(col(fold), slope.alias("_slope"), (cy - slope * cx).alias("_icpt"))
    return (usable.join(F.broadcast(fits), fold, "left")
            .withColumn("oof_prediction", F.col("_icpt") + F.col("_slope") * x)
            .drop("_slope", "_icpt"))
