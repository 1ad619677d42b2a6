"""Feature preparation (F1-F11): imputers, one-hot encoding, label encoding.

Fill values are fitted with one aggregate over all columns (median/mean) or with the
long-form value counts (most frequent, ties -> smallest) and applied in one projection.
The fitted values are per-column scalars (bounded by the schema width).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, is_missing, is_numeric_type
from tessera.operators.dictionary import Dictionary, fit_dictionary
from tessera.operators.order_stats import exact_quantiles

NUMERIC_STRATEGIES = ("median", "mean", "most_frequent", "constant", "drop")
CATEGORICAL_STRATEGIES = ("most_frequent", "constant")


def split_features(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """numeric vs categorical by type (booleans are categorical)."""
    num = [f for f in features if is_numeric_type(df.schema[f].dataType)]
    return num, [f for f in features if f not in num]


def most_frequent(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column the most frequent present value (ties -> smallest), as one long-form
    count with partial aggregation; returns (name, num, txt)."""
    parts = []
    for c in cols:
        num = is_numeric_type(df.schema[c].dataType)
        parts.append(F.when(~is_missing(df, c), F.struct(
            F.lit(c).alias("name"),
            (col(c).cast("double") if num else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if num else col(c).cast("string")).alias("txt"))))
    long = df.select(F.explode(F.array(*parts)).alias("v")).filter(F.col("v").isNotNull()).select("v.*")
    counts = long.groupBy("name", "num", "txt").agg(F.count(F.lit(1)).alias("cnt"))
    best = F.min_by(F.struct("num", "txt"), F.struct((-F.col("cnt")).alias("k"), F.col("num"), F.col("txt")))
    return counts.groupBy("name").agg(best.alias("b")).select("name", "b.num", "b.txt")


@dataclass
class ImputerModel:
    fills: dict[str, object]
    drop_cols: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        if self.drop_cols:
            cond = F.lit(True)
            for c in self.drop_cols:
                cond = cond & ~is_missing(df, c)
            df = df.filter(cond)
        out = []
        for c in df.columns:
            if c in self.fills and self.fills[c] is not None:
                v = self.fills[c]
                dt = df.schema[c].dataType
                # a fractional fill of an integer column widens it to double (no truncation)
                target = "double" if is_numeric_type(dt) and isinstance(v, float) else dt
                out.append(F.when(is_missing(df, c), F.lit(v).cast(target)).otherwise(col(c).cast(target)).alias(c))
            else:
                out.append(col(c))
        return df.select(*out)


def fit_imputer(df: DataFrame, numeric: list[str], categorical: list[str], numeric_strategy: str = "median",
                categorical_strategy: str = "most_frequent", numeric_constant: float = 0.0,
                categorical_constant: str = "Missing", accuracy: int | None = None) -> ImputerModel:
    if numeric_strategy not in NUMERIC_STRATEGIES:
        raise ValueError(f"numeric imputer must be one of {NUMERIC_STRATEGIES}")
    if categorical_strategy not in CATEGORICAL_STRATEGIES:
        raise ValueError(f"categorical imputer must be one of {CATEGORICAL_STRATEGIES}")
    fills: dict[str, object] = {}
    drop: tuple[str, ...] = ()
    if numeric_strategy == "drop":
        drop = tuple(numeric + categorical)
    elif numeric_strategy == "constant":
        fills.update({c: float(numeric_constant) for c in numeric})
    elif numeric_strategy in ("median", "mean") and numeric:
        present = {c: F.when(~is_missing(df, c), col(c).cast("double")) for c in numeric}
        if numeric_strategy == "median" and not accuracy:
            fills.update({c: m for c, (m,) in exact_quantiles(df, present, [0.5]).items()})
        else:
            fit = F.avg if numeric_strategy == "mean" else lambda x: F.percentile_approx(x, 0.5, accuracy).cast("double")
            row = df.agg(*[fit(x).alias(f"v{i}") for i, x in enumerate(present.values())]).first()
            fills.update({c: row[f"v{i}"] for i, c in enumerate(numeric)})
    mf_cols = (numeric if numeric_strategy == "most_frequent" else []) + \
              (categorical if categorical_strategy == "most_frequent" else [])
    if mf_cols:
        for r in most_frequent(df, mf_cols).collect():
            fills[r["name"]] = r["num"] if r["name"] in numeric else r["txt"]
    if categorical_strategy == "constant":
        fills.update({c: categorical_constant for c in categorical})
    return ImputerModel(fills, drop)


def fit_one_hot(df: DataFrame, column: str) -> Dictionary:
    """alphabetical category numbers, however many there are; an unseen category at
    transform time has none, so it encodes as all zeros."""
    return fit_dictionary(df, [column])


def one_hot_slot(df: DataFrame, column: str, dictionary: Dictionary) -> DataFrame:
    """``df`` with the encoded vector as (width, hot slot or null)."""
    return dictionary.encode(df, column, "slot").withColumn("width", F.lit(dictionary.sizes[column]).cast("int")) \
        .withColumn("slot", F.col("slot").cast("int"))


def label_encode(df: DataFrame, label: str, out: str = "label_index") -> tuple[DataFrame, Dictionary]:
    """string classes -> 0..k-1 in alphabetical order (and the dictionary, which decodes
    indices back). Rows without a label are refused, as are labels unknown to it."""
    known = fit_dictionary(df, [label])
    rows = known.encode(df, label, out)
    return rows.withColumn(out, F.when(F.col(out).isNull(), F.raise_error(F.lit(f"'{label}' holds a missing label")).cast("double"))
                           .otherwise(F.col(out).cast("double"))), known


def impute_per_fold(df: DataFrame, fold: str, k: int, median_cols: list[str], mean_cols: list[str]) -> DataFrame:
    """each fold's gaps are filled from the statistics of the *other* folds.

    Means use per-fold sums and counts (complement = total - fold); medians of all complements
    are selected together (a series per column and fold). The fitted table has one
    row per fold and is broadcast back by fold."""
    medians = exact_quantiles(df, {f"{c}/{f}": F.when((col(fold) != f) & ~is_missing(df, c), col(c).cast("double"))
                                   for c in median_cols for f in range(k)}, [0.5])
    aggs = []
    for c in mean_cols:
        x = F.when(~is_missing(df, c), col(c).cast("double"))
        for f in range(k):
            in_comp = col(fold) != f
            aggs += [F.sum(F.when(in_comp, x)).alias(f"s_{c}_{f}"), F.count(F.when(in_comp, x)).alias(f"n_{c}_{f}")]
    wide = df.agg(*aggs, F.count("*").alias("rows"))
    rows = []
    for f in range(k):
        fields = [F.lit(f).alias(fold)]
        fields += [(F.col(f"s_{c}_{f}") / F.col(f"n_{c}_{f}")).alias(f"_fill_{c}") for c in mean_cols]
        fields += [F.lit(medians[f"{c}/{f}"][0]).cast("double").alias(f"_fill_{c}") for c in median_cols]
        rows.append(F.struct(*fields))
    fits = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    j = df.join(F.broadcast(fits), fold, "left")
    for c in mean_cols + median_cols:
        j = j.withColumn(c, F.when(is_missing(j, c), F.col(f"_fill_{c}").cast(df.schema[c].dataType)).otherwise(col(c)))
    return j.drop(*[f"_fill_{c}" for c in mean_cols + median_cols])
