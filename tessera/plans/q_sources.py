"""Source and sink queries (S1-S15). Each writes what it needs into a fresh folder under
the session's shared checkpoint folder and reads it back with the library readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import NA_TOKENS, source_name
from tessera.operators.score import FeatureSpec, Manifest, score
from tessera.plans.catalog import query
from tessera.plans.fixtures import LINEITEM_NA_SQL, lineitem_na, table
from tessera.plans.q_logs import JOBS_SQL
from tessera.plans.q_score import KEY_COLS, PRICE_MANIFEST, PRICE_MODEL, PRICE_SQL
from tessera.plans.requests import TRAINING_REQUESTS_SQL
from tessera.session import scratch_path
from tessera.sources import records as R
from tessera.sources import store as S
from tessera.sources import text as TX


# ------------------------------------------------------------------ S1 / S2 text tables
# supplier written as text with 'N/A' for s_name when s_suppkey % 7 = 0, then read back.
@query("src_csv_roundtrip", """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS s_name,
       CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier""")
def q_src_csv_roundtrip(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    s = s.withColumn("s_name", F.when(F.col("s_suppkey") % 7 == 0, F.lit("N/A")).otherwise(F.col("s_name")))
    path = TX.write_table(s, scratch_path(spark, "supplier_csv"))
    return TX.read_table(spark, path)


# documents written as text with a quoted header that holds a comma; texts hold line ends, quotes and commas.
@query("src_csv_quoted", f"""
SELECT doc_id, CASE WHEN text IN ({", ".join("'" + t + "'" for t in NA_TOKENS)}) THEN NULL ELSE md5(text) END AS text_md5,
       lang AS "lang, name" FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, lang FROM documents)""")
def q_src_csv_quoted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text, whole"), F.col("lang").alias("lang, name"))
    back = TX.read_table(spark, TX.write_table(d, scratch_path(spark, "documents_csv")), infer=False)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("`text, whole`").cast("binary")).alias("text_md5"), "`lang, name`")


@query("src_csv_scoring", """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey,
       round(1.5 * n_regionkey + 0.25 * n_nationkey, 4) AS prediction FROM nation""")
def q_src_csv_scoring(spark, sf_dir):
    """Scoring input is read as UTF-8 only, then scored with a fixed linear model."""
    path = TX.write_table(table(spark, sf_dir, "nation"), scratch_path(spark, "nation_csv"))
    df = TX.read_table(spark, path, encodings=TX.SCORING_ENCODINGS)
    from tessera.operators.score import LinearModel
    man = Manifest(id="n", name="n", features=(FeatureSpec("n_regionkey", "int64"), FeatureSpec("n_nationkey", "int64")))
    res = score(df, man, LinearModel(0.0, {"n_regionkey": 1.5, "n_nationkey": 0.25}), ground_truth="")
    return res.predictions


# ------------------------------------------------------------------ S3 JSON request bodies
# One request body per event: {"data": [record]} when event_id is even, the legacy
# {"records": [record]} when odd; record = {event_id, k, value}.
REC_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType()),
                           T.StructField("value", T.DoubleType())])


@query("src_json_records", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events""")
def q_src_json_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "struct<k: bigint>")["k"]
    rec = F.array(F.struct(F.col("event_id"), k.alias("k"), F.col("value")))
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(rec.alias("data")))) \
        .otherwise(F.to_json(F.struct(rec.alias("records"))))
    path = scratch_path(spark, "bodies")
    e.select(body.alias("body")).write.mode("overwrite").text(path)
    bodies = spark.read.text(path).withColumnRenamed("value", "body")
    return R.records_from_bodies(bodies, "body", REC_SCHEMA)


# ------------------------------------------------------------------ S4 / S5 / S15 dataset store
# customer stored as datasets by market segment: dataset_id = lower(c_mktsegment);
# uploaded file name 'uploads\\<segment>/<segment>_customers.v1.csv'; created_at = the first
# order date of the segment's customers.
UPLOADS_SQL = """up AS (SELECT lower(c_mktsegment) AS dataset_id, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS created_at
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"""


def _store(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    root = scratch_path(spark, "datasets")
    S.store_datasets(c, root, F.lower(F.col("c_mktsegment")))
    return root


@query("src_dataset_scan", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'""")
def q_src_dataset_scan(spark, sf_dir):
    return S.scan_dataset(spark, _store(spark, sf_dir), "building")


def _uploads(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    ids = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.lower("c_mktsegment").alias("dataset_id")) \
        .agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    fname = F.concat(F.lit("uploads\\"), F.col("dataset_id"), F.lit("/"), F.col("dataset_id"), F.lit("_customers.v1.csv"))
    return ids.select("dataset_id", fname.alias("original_filename"), "created_at")


@query("dataset_metadata", f"""
WITH {UPLOADS_SQL}
SELECT lower(c_mktsegment) AS dataset_id, lower(c_mktsegment) || '_customers.v1' AS name,
       'uploads\\' || lower(c_mktsegment) || '/' || lower(c_mktsegment) || '_customers.v1.csv' AS original_filename,
       count(*) AS row_count, 5 AS column_count, max(created_at) AS created_at
FROM customer JOIN up ON up.dataset_id = lower(c_mktsegment) GROUP BY 1""")
def q_dataset_metadata(spark, sf_dir):
    return S.dataset_metadata(spark, _store(spark, sf_dir), _uploads(spark, sf_dir))


@query("dataset_list", f"""
WITH {UPLOADS_SQL}
SELECT lower(c_mktsegment) AS dataset_id, count(*) AS row_count, max(created_at) AS created_at
FROM customer JOIN up ON up.dataset_id = lower(c_mktsegment) GROUP BY 1""")
def q_dataset_list(spark, sf_dir):
    meta = S.dataset_metadata(spark, _store(spark, sf_dir), _uploads(spark, sf_dir))
    return S.newest_first(meta, "created_at", "dataset_id").select("dataset_id", "row_count", "created_at")


# ------------------------------------------------------------------ S6 / S7 sinks
@query("sink_csv", f"""
WITH src AS ({LINEITEM_NA_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({PRICE_SQL}, 4) AS price_prediction
FROM src WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def q_sink_csv(spark, sf_dir):
    res = score(lineitem_na(spark, sf_dir), PRICE_MANIFEST, PRICE_MODEL, ground_truth="")
    path = scratch_path(spark, f"{PRICE_MANIFEST.name}_predictions.csv")
    TX.write_table(res.predictions.select(*KEY_COLS, "price_prediction"), path)
    return TX.read_table(spark, path, encodings=TX.SCORING_ENCODINGS)


@query("sink_json_records", """
WITH r AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                  CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT event_id, k, value, round(3.0 + 0.5 * k, 4) AS prediction FROM r WHERE k IS NOT NULL""")
def q_sink_json_records(spark, sf_dir):
    """Scored records written as JSON with nulls kept (the record's missing value
    travels as null), then read back with the declared schema."""
    from tessera.plans.q_score import JSON_MODEL, json_records
    man = Manifest(id="json", name="json", features=(FeatureSpec("k", "int64"),))
    res = score(json_records(spark, sf_dir), man, JSON_MODEL, ground_truth="")
    path = R.write_records(res.predictions, scratch_path(spark, "records_json"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType()),
                           T.StructField("value", T.DoubleType()), T.StructField("prediction", T.DoubleType())])
    return R.read_records(spark, path, schema)


# ------------------------------------------------------------------ S8 / S9 / S10 history
# One scoring run per event: id md5(event_id), model md5('model-' || user_id),
# source file 'C:\\uploads\\u<user_id>\\batch_<event_id>.csv' (even event ids) or
# 'in/u<user_id>/batch_<event_id>.csv' (odd), row_count = floor(value * 10),
# created_at = ts; appended in two batches (even / odd event ids).
HISTORY_SRC_SQL = """
SELECT md5(CAST(event_id AS VARCHAR)) AS id, md5('model-' || CAST(user_id AS VARCHAR)) AS model_id,
       CASE WHEN event_id % 2 = 0 THEN 'C:\\uploads\\u' || CAST(user_id AS VARCHAR) || '\\batch_' || CAST(event_id AS VARCHAR) || '.csv'
            ELSE 'in/u' || CAST(user_id AS VARCHAR) || '/batch_' || CAST(event_id AS VARCHAR) || '.csv' END AS raw_source,
       CAST(floor(value * 10) AS BIGINT) AS row_count, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, event_id
FROM events"""


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u, i = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    src = F.when(F.col("event_id") % 2 == 0,
                 F.concat(F.lit("C:\\uploads\\u"), u, F.lit("\\batch_"), i, F.lit(".csv"))) \
        .otherwise(F.concat(F.lit("in/u"), u, F.lit("/batch_"), i, F.lit(".csv")))
    return e.select(F.md5(i).alias("id"), F.md5(F.concat(F.lit("model-"), u)).alias("model_id"),
                    src.alias("raw_source"), F.floor(F.col("value") * 10).cast("bigint").alias("row_count"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "event_id")


def _history(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("source_filename", source_name(F.col("raw_source"))).drop("raw_source")
    path = scratch_path(spark, "history")
    S.append_table(runs.filter(F.col("event_id") % 2 == 0), path)
    S.append_table(runs.filter(F.col("event_id") % 2 == 1), path)
    return spark.read.parquet(path)


@query("history_append", f"""
SELECT id, model_id, string_split(replace(raw_source, '\\', '/'), '/')[-1] AS source_filename, row_count, created_at, event_id
FROM ({HISTORY_SRC_SQL})""")
def q_history_append(spark, sf_dir):
    return _history(spark, sf_dir)


@query("history_list", f"""
SELECT id, model_id, string_split(replace(raw_source, '\\', '/'), '/')[-1] AS source_filename, row_count, created_at
FROM ({HISTORY_SRC_SQL})""")
def q_history_list(spark, sf_dir):
    return S.newest_first(_history(spark, sf_dir), "created_at", "id") \
        .select("id", "model_id", "source_filename", "row_count", "created_at")


@query("history_source_name", f"""
SELECT id, raw_source, string_split(replace(raw_source, '\\', '/'), '/')[-1] AS source_filename FROM ({HISTORY_SRC_SQL})""")
def q_history_source_name(spark, sf_dir):
    return _runs(spark, sf_dir).select("id", "raw_source", source_name(F.col("raw_source")).alias("source_filename"))


# ------------------------------------------------------------------ S11 manifests
# One manifest per part row, grouped into 50 package folders (p_partkey % 50):
# id 'model-<key>', name p_name, features [p_size, p_retailprice], target p_brand.
@query("manifest_scan", """
SELECT 'model-' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 'package=pkg_' || CAST(p_partkey % 50 AS VARCHAR) AS package_dir,
       2 AS n_features, 'classification' AS problem_type FROM part""")
def q_manifest_scan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    feat = F.array(F.struct(F.lit("p_size").alias("name"), F.lit("int64").alias("dtype"), F.lit(True).alias("required")),
                   F.struct(F.lit("p_retailprice").alias("name"), F.lit("float64").alias("dtype"),
                            F.lit(True).alias("required")))
    m = p.select(F.concat(F.lit("model-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
                 F.lit("1.0.0").alias("version"), F.lit("spark").alias("framework"),
                 F.lit("classification").alias("problem_type"), F.lit("p_brand").alias("target"), feat.alias("features"),
                 F.concat(F.lit("pkg_"), (F.col("p_partkey") % 50).cast("string")).alias("package"))
    root = scratch_path(spark, "ml_models")
    m.write.mode("overwrite").partitionBy("package").json(root)
    scanned = S.scan_manifests(spark, root, name=None)
    return scanned.select("id", "name", "package_dir", F.size("features").alias("n_features"), "problem_type")


# A package per brand: one indented metadata.json in a folder of its own, features by the brand's part types.
@query("manifest_folders", """
SELECT 'model-' || p_brand AS id, p_brand AS name, replace(p_brand, '#', '-') AS package_dir, count(DISTINCT p_type) AS n_features,
       'regression' AS problem_type FROM part GROUP BY p_brand""")
def q_manifest_folders(spark, sf_dir):
    from tessera.sources.runs import write_document
    root = scratch_path(spark, "packages")
    for r in table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types")).collect():       # a package per brand
        write_document(spark, f"{root}/{r.p_brand.replace('#', '-')}/metadata.json", {
            "id": f"model-{r.p_brand}", "name": r.p_brand, "version": "1.0.0", "framework": "spark", "problem_type": "regression",
            "target": "p_retailprice", "features": [{"name": t, "dtype": "float64", "required": True} for t in sorted(r.types)]})
    return S.scan_manifests(spark, root).select("id", "name", "package_dir", F.size("features").cast("long").alias("n_features"), "problem_type")


# ------------------------------------------------------------------ S12 / S13 job and model records
@query("job_scan", f"""
WITH {JOBS_SQL}, r AS ({TRAINING_REQUESTS_SQL})
SELECT st.job_id, status, attempt, first_seq, last_seq, dataset_id AS request_dataset_id, algorithm AS request_algorithm,
       target_column AS request_target_column, cv_folds AS request_cv_folds FROM st LEFT JOIN r ON r.request_id = st.job_id""")
def q_job_scan(spark, sf_dir):
    from tessera.plans.q_logs import _state
    from tessera.plans.requests import training_requests
    st = _state(spark, sf_dir)
    req = training_requests(spark, sf_dir).select(F.col("request_id").alias("job_id"), "dataset_id", "algorithm",
                                                   "target_column", "cv_folds")
    rec = st.join(req, "job_id", "left").select(
        F.struct("job_id", "status", "attempt", "first_seq", "last_seq").alias("job"),
        F.struct("dataset_id", "algorithm", "target_column", "cv_folds").alias("request"))
    root = scratch_path(spark, "training_jobs")
    rec.write.mode("overwrite").json(root)
    return S.scan_job_records(spark, root)


# Trained-model records: one per event (a completed training run):
# id md5('trained-' || event_id), name 'run <event_id>', algorithm by event_id % 9,
# completed_at = ts (text, to the second).
@query("trained_model_list", """
SELECT md5('trained-' || CAST(event_id AS VARCHAR)) AS id, 'run ' || CAST(event_id AS VARCHAR) AS name,
       ['random_forest', 'gradient_boosting', 'xgboost', 'adaboost', 'random_forest_classifier',
        'gradient_boosting_classifier', 'xgboost_classifier', 'adaboost_classifier', 'logistic_regression'][event_id % 9 + 1] AS algorithm,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS completed_at
FROM events""")
def q_trained_model_list(spark, sf_dir):
    from tessera.plans.requests import ALGORITHMS
    e = table(spark, sf_dir, "events")
    algo = F.element_at(F.array(*[F.lit(a) for a in ALGORITHMS]), (F.col("event_id") % 9).cast("int") + 1)
    rec = e.select(F.md5(F.concat(F.lit("trained-"), F.col("event_id").cast("string"))).alias("id"),
                   F.concat(F.lit("run "), F.col("event_id").cast("string")).alias("name"), algo.alias("algorithm"),
                   F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))
    root = scratch_path(spark, "trained_models")
    rec.write.mode("overwrite").json(root)
    return S.scan_trained_models(spark, root, name=None)
