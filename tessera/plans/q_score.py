"""Scoring queries (X1-X11) and the minimum slice."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import metrics as M
from tessera.operators.score import FeatureSpec, LinearModel, Manifest, score
from tessera.operators.trees import Stump
from tessera.plans.catalog import query
from tessera.plans.fixtures import LINEITEM_NA_SQL, lineitem_na, table
from tessera.plans.sqlfrag import classification_sql, regression_select

# Fixed model used by the scoring queries (price from quantity, discount, tax).
PRICE_MODEL = LinearModel(intercept=2000.0,
                          coefficients={"l_quantity": 1400.0, "l_discount": -3000.0, "l_tax": 1000.0})
PRICE_MANIFEST = Manifest(
    id="price-linear", name="Price", problem_type="regression", target="l_extendedprice",
    features=(FeatureSpec("l_quantity", "float64"), FeatureSpec("l_discount", "float64"),
              FeatureSpec("l_tax", "float64")),
    prediction_column="price_prediction")
PRICE_SQL = "(2000.0 + 1400.0 * l_quantity + -3000.0 * l_discount + 1000.0 * l_tax)"
KEPT_SQL = ("l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL "
            "AND l_extendedprice IS NOT NULL")

# Return-flag rule (a one-split tree): quantity above 25 -> 'R', else 'N'.
FLAG_MODEL = Stump("l_quantity", 25.0, "N", "R")
FLAG_MANIFEST = Manifest(
    id="flag-stump", name="Flag", problem_type="classification", target="l_returnflag",
    features=(FeatureSpec("l_quantity", "float64"),), prediction_column="flag_prediction")
FLAG_SQL = "(CASE WHEN l_quantity <= 25.0 THEN 'N' ELSE 'R' END)"

KEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def score_and_metrics_df(spark, sf_dir):
    res = score(lineitem_na(spark, sf_dir), PRICE_MANIFEST, PRICE_MODEL, ground_truth="l_extendedprice")
    return res.metrics


@query("score_and_metrics", f"""
WITH src AS ({LINEITEM_NA_SQL}),
kept AS (SELECT l_extendedprice AS y, {PRICE_SQL} AS p FROM src WHERE {KEPT_SQL})
SELECT (SELECT count(*) FROM kept) AS rows,
       (SELECT count(*) FROM src) - (SELECT count(*) FROM kept) AS dropped_rows,
       {regression_select('y', 'p')}
FROM kept""")
def q_score_and_metrics(spark, sf_dir):
    return score_and_metrics_df(spark, sf_dir)


@query("score_linear", f"""
WITH src AS ({LINEITEM_NA_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({PRICE_SQL}, 4) AS price_prediction
FROM src WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def q_score_linear(spark, sf_dir):
    # no ground truth: evaluation disabled (''), rows missing a feature dropped
    res = score(lineitem_na(spark, sf_dir), PRICE_MANIFEST, PRICE_MODEL, ground_truth="")
    return res.predictions.select(*KEY_COLS, "price_prediction")


@query("score_with_error", f"""
WITH src AS ({LINEITEM_NA_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       round({PRICE_SQL}, 4) AS price_prediction,
       round({PRICE_SQL} - l_extendedprice, 4) AS prediction_error
FROM src WHERE {KEPT_SQL}""")
def q_score_with_error(spark, sf_dir):
    res = score(lineitem_na(spark, sf_dir), PRICE_MANIFEST, PRICE_MODEL)  # target auto-detected
    return res.predictions.select(*KEY_COLS, "l_extendedprice", "price_prediction", "prediction_error")


@query("score_with_correct", f"""
WITH src AS ({LINEITEM_NA_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
       {FLAG_SQL} AS flag_prediction,
       ({FLAG_SQL} = l_returnflag) AS prediction_correct
FROM src WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL""")
def q_score_with_correct(spark, sf_dir):
    res = score(lineitem_na(spark, sf_dir), FLAG_MANIFEST, FLAG_MODEL)
    return res.predictions.select(*KEY_COLS, "l_returnflag", "flag_prediction", "prediction_correct")


@query("metric_classification", f"""
WITH src AS ({LINEITEM_NA_SQL}),
k AS (SELECT l_returnflag AS y, {FLAG_SQL} AS p FROM src WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL),
{classification_sql('k', 'y', 'p').strip()}
SELECT accuracy, precision, recall, f1 FROM cm""")
def q_metric_classification(spark, sf_dir):
    res = score(lineitem_na(spark, sf_dir), FLAG_MANIFEST, FLAG_MODEL)
    return res.metrics.select("accuracy", "precision", "recall", "f1")


@query("metric_regression", f"""
WITH src AS ({LINEITEM_NA_SQL}),
kept AS (SELECT l_extendedprice AS y, {PRICE_SQL} AS p FROM src WHERE {KEPT_SQL})
SELECT {regression_select('y', 'p')} FROM kept""")
def q_metric_regression(spark, sf_dir):
    res = score(lineitem_na(spark, sf_dir), PRICE_MANIFEST, PRICE_MODEL, ground_truth="l_extendedprice")
    return res.metrics.drop("rows", "dropped_rows")


@query("metric_external", f"""
WITH src AS ({LINEITEM_NA_SQL}),
kept AS (SELECT l_extendedprice AS y, {PRICE_SQL} AS p FROM src WHERE {KEPT_SQL})
SELECT {regression_select('y', 'p', external=True)} FROM kept""")
def q_metric_external(spark, sf_dir):
    res = score(lineitem_na(spark, sf_dir), PRICE_MANIFEST, PRICE_MODEL, ground_truth="")
    scored = res.predictions.filter(F.col("l_extendedprice").isNotNull())
    # full-precision prediction for metrics (the rounded column is for display)
    scored = scored.withColumn("_p", PRICE_MODEL.margin())
    return M.regression_metrics(scored, "l_extendedprice", "_p", external=True)


# Logistic model with fixed coefficients: P(quantity band 'high') from discount and tax.
RISK_MODEL = LinearModel(intercept=-1.5, coefficients={"l_discount": 12.0, "l_tax": 8.0},
                         link="logistic", classes=("low", "high"))
RISK_Z_SQL = "(-1.5 + 12.0 * l_discount + 8.0 * l_tax)"


@query("score_probability", f"""
WITH src AS ({LINEITEM_NA_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(1.0 - 1.0 / (1.0 + exp(-{RISK_Z_SQL})), 6) AS proba_low,
       round(1.0 / (1.0 + exp(-{RISK_Z_SQL})), 6) AS proba_high,
       CASE WHEN 1.0 / (1.0 + exp(-{RISK_Z_SQL})) > 0.5 THEN 'high' ELSE 'low' END AS risk_prediction
FROM src WHERE l_tax IS NOT NULL AND l_discount IS NOT NULL""")
def q_score_probability(spark, sf_dir):
    man = Manifest(id="risk", name="Risk", problem_type="classification",
                   features=(FeatureSpec("l_discount"), FeatureSpec("l_tax")), prediction_column="risk_prediction")
    res = score(lineitem_na(spark, sf_dir), man, RISK_MODEL, ground_truth="")
    p = RISK_MODEL.probability()
    return res.predictions.select(*KEY_COLS, F.round(1.0 - p, 6).alias("proba_low"),
                                  F.round(p, 6).alias("proba_high"), "risk_prediction")


@query("feature_projection", f"""
WITH src AS ({LINEITEM_NA_SQL})
SELECT l_tax, l_quantity, l_discount FROM src
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def q_feature_projection(spark, sf_dir):
    from tessera.operators.validate import clean_required_rows, project_features
    man = Manifest(id="p", name="p", features=(FeatureSpec("l_tax"), FeatureSpec("l_quantity"),
                                              FeatureSpec("l_discount")))
    kept, _ = clean_required_rows(lineitem_na(spark, sf_dir), man, None)
    return project_features(kept, man)


# JSON records: events as request records {event_id, k (from props), value}; value
# injected missing when event_id % 41 = 0. Model: value ~ 3 + 0.5 k.
JSON_MODEL = LinearModel(intercept=3.0, coefficients={"k": 0.5})


def json_records(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return ev.select("event_id", parsed["k"].alias("k"),
                     F.when(F.col("event_id") % 41 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))


@query("score_json_records", """
WITH r AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                  CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS value FROM events),
kept AS (SELECT * FROM r WHERE k IS NOT NULL AND value IS NOT NULL)
SELECT event_id, k, value, round(3.0 + 0.5 * k, 4) AS prediction,
       round(3.0 + 0.5 * k - value, 4) AS prediction_error
FROM kept""")
def q_score_json_records(spark, sf_dir):
    man = Manifest(id="json", name="json", target="value", features=(FeatureSpec("k", "int64"),))
    res = score(json_records(spark, sf_dir), man, JSON_MODEL)
    return res.predictions.select("event_id", "k", "value", "prediction", "prediction_error")


# Multi-model scoring: each lineitem row names a model (l_suppkey % 30); the model
# table is derived from nation (id = n_nationkey, intercept = 100 * n_regionkey,
# slope = n_nationkey / 10, framework 'onnx' when n_nationkey % 7 = 3 else 'spark').
def model_table(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("model_id"),
                    (F.col("n_regionkey") * 100.0).alias("intercept"),
                    (F.col("n_nationkey") / 10.0).alias("slope"),
                    F.when(F.col("n_nationkey") % 7 == 3, F.lit("ONNX")).otherwise(F.lit("Spark")).alias("framework"))


@query("score_multi_model", """
WITH rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_suppkey % 30 AS model_id FROM lineitem),
m AS (SELECT CAST(n_nationkey AS BIGINT) AS model_id, n_regionkey * 100.0 AS intercept, n_nationkey / 10.0 AS slope,
             CASE WHEN n_nationkey % 7 = 3 THEN 'ONNX' ELSE 'Spark' END AS framework FROM nation)
SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.model_id,
       CASE WHEN m.model_id IS NULL THEN 'unknown_model'
            WHEN lower(m.framework) <> 'spark' THEN 'unsupported_framework' ELSE 'scored' END AS status,
       CASE WHEN m.model_id IS NOT NULL AND lower(m.framework) = 'spark'
            THEN round(m.intercept + m.slope * r.l_quantity, 4) END AS prediction
FROM rows r LEFT JOIN m ON r.model_id = m.model_id""")
def q_score_multi_model(spark, sf_dir):
    from tessera.operators.score import score_by_model_table
    li = table(spark, sf_dir, "lineitem").select(*KEY_COLS, "l_quantity",
                                                 (F.col("l_suppkey") % 30).alias("model_id"))
    return score_by_model_table(li, model_table(spark, sf_dir), feature="l_quantity").select(
        *KEY_COLS, "model_id", "status", "prediction")


# ------------------------------------------------------------------ streaming
@query("stream_score_records", """
WITH r AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                  CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT event_id, k, value, round(3.0 + 0.5 * k, 4) AS prediction FROM r WHERE k IS NOT NULL""")
def q_stream_score_records(spark, sf_dir):
    """X11 over Structured Streaming: the events table read as a file stream, scored
    batch by batch with the batch operator, appended to a table, read back."""
    from tessera.session import scratch_path
    from tessera.streaming.scoring import score_stream
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")  # a glob: file streams watch folders
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    records = stream.select("event_id", parsed["k"].alias("k"),
                            F.when(F.col("event_id") % 41 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))
    man = Manifest(id="json", name="json", features=(FeatureSpec("k", "int64"),))
    out, hist, ck = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_hist"), scratch_path(spark, "stream_ck")
    score_stream(records, man, JSON_MODEL, out, hist, ck).awaitTermination()
    return spark.read.parquet(out).select("event_id", "k", "value", "prediction")


# One model per supplier (key s): framework 'onnx' where s % 11 = 0, logistic where s % 3 = 1 else linear, fill 10 for
# quantity and 0.02 for tax (none for discount), quantity scaled by 2; rows name the model of their supplier, those with
# l_orderkey % 41 = 0 a model that does not exist.
_Z = ("(0.1 * (s % 5) + 0.5 * (s % 7) * (coalesce(l_quantity, 10.0) / 2.0) + -3.0 * l_discount + 1.5 * (s % 4) * coalesce(l_tax, 0.02) "
      "- CASE WHEN s % 3 = 1 THEN 20.0 ELSE 0.0 END)")


@query("score_manifest_table", f"""
WITH rows AS (SELECT l_orderkey * 8 + l_linenumber AS key, CASE WHEN l_orderkey % 41 = 0 THEN 'gone' ELSE 'supplier-' || CAST(l_suppkey AS VARCHAR) END AS model_id,
                     l_suppkey AS s, l_orderkey, l_quantity, l_discount, l_tax FROM ({LINEITEM_NA_SQL})),
r AS (SELECT *, CASE WHEN l_orderkey % 41 = 0 OR s NOT IN (SELECT s_suppkey FROM supplier) THEN 'unknown_model' WHEN s % 11 = 0 THEN 'unsupported_framework'
                     WHEN l_discount IS NULL THEN 'missing_feature' END AS reason, {_Z} AS z FROM rows),
p AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN s % 3 = 1 THEN 1 / (1 + exp(-z)) ELSE z END END AS y FROM r)
SELECT key, model_id, round(y, 4) AS prediction, CASE WHEN reason IS NULL AND s % 3 = 1 THEN CASE WHEN y > 0.5 THEN 'high' ELSE 'low' END END AS label, reason FROM p""")
def q_score_manifest_table(spark, sf_dir):
    """Several features, two families, a leading preprocessing step, rejects beside the predictions."""
    from tessera.operators.model_table import score_by_manifest
    s = F.col("s_suppkey")
    model = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier-"), s.cast("string")).alias("model_id"), F.when(s % 11 == 0, F.lit("onnx")).otherwise(F.lit("spark")).alias("framework"),
        F.when(s % 3 == 1, F.lit("logistic")).otherwise(F.lit("linear")).alias("family"),
        F.array(F.lit("l_quantity"), F.lit("l_discount"), F.lit("l_tax")).alias("features"),
        F.array(F.lit(10.0), F.lit(None).cast("double"), F.lit(0.02)).alias("fill"), F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)).alias("scale"),
        F.array(0.5 * (s % 7), F.lit(-3.0), 1.5 * (s % 4)).alias("weights"),
        (0.1 * (s % 5) - F.when(s % 3 == 1, 20.0).otherwise(0.0)).alias("intercept"),
        F.when(s % 3 == 1, F.array(F.lit("low"), F.lit("high"))).alias("classes"))
    li = lineitem_na(spark, sf_dir)
    rows = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), F.when(F.col("l_orderkey") % 41 == 0, F.lit("gone")).otherwise(
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"))).alias("model_id"),
        F.create_map(*[x for c in ("l_quantity", "l_discount", "l_tax") for x in (F.lit(c), F.col(c))]).alias("inputs"))
    out = score_by_manifest(rows, model, key="key")
    return out.predictions.select("key", "model_id", F.round("prediction", 4).alias("prediction"), "label", F.lit(None).cast("string").alias("reason")) \
        .unionByName(out.rejects.select("key", "model_id", F.lit(None).cast("double").alias("prediction"), F.lit(None).cast("string").alias("label"), "reason"))
