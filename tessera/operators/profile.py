"""Column profiling (P1-P19): one output row per input column, in input order.

Plan (independent of the number of rows):
  pass 1a  one wide aggregate: missing counts, min/max/mean/std per numeric column; quartiles by
           distributed selection (``order_stats``), all columns in the same passes
  pass 1b  one long-form value count: (column, value) -> count with map-side partial
           aggregation, then per column the number of distinct values and the mode
           (ties -> smallest value). A dominant value is collapsed before the shuffle.
  pass 2   outlier counts: one wide aggregate with the IQR fences of pass 1a as literals
           (the fences are per-column scalars, bounded by the schema width)
The per-column tables are joined on the column position; each has one row per column,
so they are broadcast by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import (FALSE_TOKENS, FLOAT_PATTERN, INF_PATTERN, INT_PATTERN,
                                       TRUE_TOKENS, col, is_missing, is_numeric_type)
from tessera.operators.order_stats import exact_quantiles

PROFILE_FIELDS = ("position", "name", "raw_dtype", "ml_type", "missing_count", "missing_rate",
                  "unique_count", "outlier_count", "minimum", "maximum", "mean", "std", "median", "mode")


def raw_dtype(dt: T.DataType) -> str:
    # one name for both timestamp flavours (files without a zone read as timestamp_ntz)
    name = dt.simpleString()
    return "timestamp" if name == "timestamp_ntz" else name


def ml_type(dt: T.DataType) -> str:
    return "numeric" if is_numeric_type(dt) else "categorical"


def column_stats(df: DataFrame, accuracy: int | None = None, quartiles: bool = True, moments: bool = True) -> DataFrame:
    """Pass 1a: per column (position, name, raw_dtype, ml_type, n, missing_count, minimum,
    maximum, mean, std, q1, median, q3). Without ``quartiles`` (or ``moments``: minimum to
    std) those columns are null and not worked out. Quartiles are exact unless ``accuracy`` asks for
    ``percentile_approx``."""
    numbers = {str(i): F.when(~is_missing(df, f.name), col(f.name).cast("double"))
               for i, f in enumerate(df.schema.fields) if is_numeric_type(f.dataType)}
    exact = exact_quantiles(df, numbers, [0.25, 0.5, 0.75]) if quartiles and not accuracy else {}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.count_if(is_missing(df, f.name)).alias(f"m{i}"))
        if is_numeric_type(f.dataType):
            x = numbers[str(i)]
            if moments:
                aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"mu{i}"),
                         F.stddev_samp(x).alias(f"sd{i}"), F.count(x).alias(f"c{i}")]
            if quartiles and accuracy:
                aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"qs{i}"))
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(df.schema.fields):
        num = is_numeric_type(f.dataType)
        d = (lambda k: F.col(f"{k}{i}")) if num and moments else (lambda k: F.lit(None).cast("double"))
        if num and quartiles and accuracy:
            qs = lambda j: F.element_at(F.col(f"qs{i}"), j).cast("double")      # noqa: E731
        else:
            qs = lambda j: F.lit(exact[str(i)][j - 1] if str(i) in exact else None).cast("double")      # noqa: E731
        cnt = F.col(f"c{i}") if num and moments else F.lit(0).cast("long")
        std = F.when(cnt == 0, F.lit(None).cast("double")).when(cnt == 1, F.lit(0.0)).otherwise(d("sd")) \
            if num and moments else F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("name"),
            F.lit(raw_dtype(f.dataType)).alias("raw_dtype"), F.lit(ml_type(f.dataType)).alias("ml_type"),
            F.col("n").alias("n"), F.col(f"m{i}").cast("long").alias("missing_count"),
            d("lo").alias("minimum"), d("hi").alias("maximum"), d("mu").alias("mean"), std.alias("std"),
            qs(1).alias("q1"), qs(2).alias("median"), qs(3).alias("q3"),
        ))
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def column_stats_schema() -> T.StructType:
    d, lg = T.DoubleType(), T.LongType()
    return T.StructType([T.StructField("position", T.IntegerType()), T.StructField("name", T.StringType()),
                         T.StructField("raw_dtype", T.StringType()), T.StructField("ml_type", T.StringType()),
                         T.StructField("n", lg), T.StructField("missing_count", lg)] +
                        [T.StructField(c, d) for c in ("minimum", "maximum", "mean", "std", "q1", "median", "q3")])


def value_stats(df: DataFrame) -> DataFrame:
    """Pass 1b: per column position, the number of distinct present values and the mode
    rendered as text (most frequent; ties -> smallest, numeric order for numbers).

    Integers travel through the shuffle as longs (2^53 and 2^53 + 1 stay two values), other
    numbers as doubles; the mode's text is formatted after the aggregation."""
    parts, kinds = [], []
    for i, f in enumerate(df.schema.fields):
        num = is_numeric_type(f.dataType)
        integral = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        kinds.append("int" if integral else ("num" if num else "text"))
        present = ~is_missing(df, f.name)
        parts.append(F.when(present, F.struct(
            F.lit(i).alias("pos"),
            (col(f.name).cast("bigint") if integral else F.lit(None).cast("bigint")).alias("whole"),
            (col(f.name).cast("double") if num and not integral else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if num else col(f.name).cast("string")).alias("txt"))))
    long = df.select(F.explode(F.array(*parts)).alias("v")).filter(F.col("v").isNotNull()).select("v.*")
    counts = long.groupBy("pos", "whole", "num", "txt").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("pos").agg(
        F.count(F.lit(1)).cast("long").alias("unique_count"),
        F.min(F.struct((-F.col("cnt")).alias("k"), "whole", "num", "txt")).alias("b"))
    kind = F.element_at(F.lit(kinds).cast("array<string>"), F.col("pos") + 1)
    text = (F.when(kind == "int", F.col("b.whole").cast("string"))
            .when(kind == "num", F.col("b.num").cast("string")).otherwise(F.col("b.txt")))
    return best.select("pos", "unique_count", text.alias("mode"))


def outlier_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Pass 2: values strictly outside [q1 - 1.5 iqr, q3 + 1.5 iqr]; 0 when iqr is 0."""
    fences = {r["position"]: (r["q1"], r["q3"]) for r in
              stats.filter(F.col("ml_type") == "numeric").select("position", "q1", "q3").collect()}
    aggs = []
    for i, f in enumerate(df.schema.fields):
        if i not in fences:
            continue
        q1, q3 = fences[i]
        if q1 is None or q3 is None or q3 - q1 == 0:
            aggs.append(F.lit(0).cast("long").alias(f"o{i}"))
            continue
        iqr = q3 - q1
        x = F.when(~is_missing(df, f.name), col(f.name).cast("double"))
        aggs.append(F.count_if((x < F.lit(q1 - 1.5 * iqr)) | (x > F.lit(q3 + 1.5 * iqr))).alias(f"o{i}"))
    if not aggs:
        return stats.sparkSession.createDataFrame([], "position int, outlier_count long")
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.col(f"o{i}").cast("long").alias("outlier_count"))
        for i in fences])).alias("s")).select("s.*")


def profile(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Whole-table profile (P14). ``accuracy`` switches quartiles to percentile_approx
    (one pass); default is exact, by distributed selection."""
    # one row per column: collected once and reused, so the wide aggregate runs once
    stats = df.sparkSession.createDataFrame(column_stats(df, accuracy).collect(), column_stats_schema())
    values = value_stats(df)
    outliers = outlier_stats(df, stats)
    out = (stats.join(F.broadcast(values), stats.position == values.pos, "left").drop("pos")
           .join(F.broadcast(outliers), "position", "left"))
    return out.select(
        "position", "name", "raw_dtype", "ml_type", "missing_count",
        F.round(F.col("missing_count") / F.greatest(F.col("n"), F.lit(1)), 4).alias("missing_rate"),
        F.coalesce(F.col("unique_count"), F.lit(0).cast("long")).alias("unique_count"),
        "outlier_count", "minimum", "maximum", "mean", "std", "median", "mode")


def feature_choices(stats: DataFrame, target: str) -> DataFrame:
    """Per column of ``column_stats`` whether it can be the target of each problem type, and whether it
    stays a feature once ``target`` is chosen."""
    return stats.select("position", "name", "ml_type", (F.col("ml_type") == "numeric").alias("regression_candidate"),
                        F.lit(True).alias("classification_candidate"), (F.col("name") != F.lit(target)).alias("feature"), "n")


def shape(df: DataFrame) -> DataFrame:
    """row_count and column_count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


# --------------------------------------------------------------------------- text tables

def infer_aggs(text_df: DataFrame) -> list:
    """Per column: present count and how many present values read as bigint / integer of any
    width / double / boolean."""
    aggs = []
    for i, f in enumerate(text_df.schema.fields):
        c = col(f.name)
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.rlike(INT_PATTERN) & F.trim(c).try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(c.rlike(INT_PATTERN)).alias(f"w{i}"),
            F.count_if(c.rlike(FLOAT_PATTERN) | c.rlike(INF_PATTERN)).alias(f"d{i}"),
            F.count_if(c.isin(*(TRUE_TOKENS + FALSE_TOKENS))).alias(f"b{i}"),
        ]
    return aggs


def type_from_counts(n, i, w, d, b) -> str:
    """The narrowest type every present value parses as (an all-missing column reads as float).
    Integers of which some do not fit 64 bits stay text: no digit is lost."""
    if n == 0:
        return "double"
    if i == n:
        return "bigint"
    if w == n:
        return "string"
    if d == n:
        return "double"
    if b == n:
        return "boolean"
    return "string"


def infer_types(text_df: DataFrame) -> DataFrame:
    """P2/P3 over a table of strings (as read from a text file, NA already nulled):
    per column the narrowest type that every present value parses as -- bigint, then
    double, then boolean, else string -- in one aggregate."""
    wide = text_df.agg(*infer_aggs(text_df))
    rows = []
    for i, f in enumerate(text_df.schema.fields):
        n = F.col(f"n{i}")
        t = (F.when(n == 0, F.lit("double"))
             .when(F.col(f"i{i}") == n, F.lit("bigint"))
             .when(F.col(f"w{i}") == n, F.lit("string"))
             .when(F.col(f"d{i}") == n, F.lit("double"))
             .when(F.col(f"b{i}") == n, F.lit("boolean"))
             .otherwise(F.lit("string")))
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), t.alias("raw_dtype")))
    out = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return out.withColumn("ml_type", F.when(F.col("raw_dtype").isin("bigint", "double"), F.lit("numeric"))
                          .otherwise(F.lit("categorical")))


def apply_types(text_df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to inferred types (one projection)."""
    out = []
    for name in text_df.columns:
        t = types.get(name, "string")
        c = F.trim(col(name))
        if t == "bigint":
            out.append(c.try_cast("bigint").alias(name))
        elif t == "double":
            out.append(c.try_cast("double").alias(name))
        elif t == "boolean":
            out.append(F.lower(c).isin("true").alias(name))
        else:
            out.append(col(name))
    return text_df.select(*out)


def file_stats(text_df: DataFrame) -> DataFrame:
    """Total rows (wholly blank rows ignored), rows with at least one blank cell,
    predictable rows."""
    cells = F.array(*[F.coalesce(F.trim(col(c)), F.lit("")) for c in text_df.columns])
    any_blank = F.exists(cells, lambda x: x == "")
    all_blank = F.forall(cells, lambda x: x == "")
    agg = text_df.agg(F.count_if(~all_blank).alias("total_rows"),
                      F.count_if(~all_blank & any_blank).alias("rows_with_blank"))
    return agg.withColumn("predictable_rows", F.col("total_rows") - F.col("rows_with_blank"))


def preview(text_df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` non-blank rows in an explicit key order (files have no order
    in Spark), each with the total non-blank row count. ``limit`` is the feature here."""
    cells = F.array(*[F.coalesce(F.trim(col(c)), F.lit("")) for c in text_df.columns])
    nonblank = text_df.filter(~F.forall(cells, lambda x: x == ""))
    total = nonblank.agg(F.count(F.lit(1)).alias("total_rows"))
    head = nonblank.orderBy(*[col(c) for c in order_by]).limit(n)
    # the single-row total rides along as a scalar subquery (no join)
    return head.select("*", total.scalar().alias("total_rows"))
