"""Contract and request audits (V1, V5-V7, V14-V22, P18) over tables of requests.

A Spark user checks many requests at once: each audit is a few joins and projections
over the request table and a column catalogue, and returns one row per violation
(an empty result means every request passes). The library's argument checks call the
same rules for a single request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.contract import ALGORITHMS, CATEGORICAL_IMPUTERS, NUMERIC_IMPUTERS, PROBLEM_TYPES, REDUCTIONS

CLASSIFIER_SUFFIX = "_classifier"


def is_classifier(algorithm) -> F.Column:
    return algorithm.endswith(CLASSIFIER_SUFFIX) | (algorithm == F.lit("logistic_regression"))


def contract_audit(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Violations of the data contract: a feature or the target absent from the dataset,
    the target used as a feature, a non-numeric regression target, a feature or the target absent from the external
    test set if there is one (``test_dataset_id``). Output: request_id, problem, column_name."""
    cat = catalogue.select("dataset_id", "column_name", "ml_type")
    feats = requests.select("request_id", "dataset_id", F.explode("feature_columns").alias("column_name"))
    missing = (feats.join(cat.select("dataset_id", "column_name"), ["dataset_id", "column_name"], "left_anti")
               .select("request_id", F.lit("missing_feature").alias("problem"), "column_name"))
    tgt = requests.join(cat.withColumnRenamed("column_name", "target_column"),
                        ["dataset_id", "target_column"], "left")
    target_problem = (F.when(F.col("ml_type").isNull(), F.lit("missing_target"))
                      .when(F.array_contains("feature_columns", F.col("target_column")), F.lit("target_is_feature"))
                      .when((F.col("problem_type") == "regression") & (F.col("ml_type") != "numeric"),
                            F.lit("target_not_numeric")))
    targets = (tgt.select("request_id", target_problem.alias("problem"), F.col("target_column").alias("column_name"))
               .filter(F.col("problem").isNotNull()))
    tested = requests.filter("test_dataset_id is not null").select("request_id", F.col("test_dataset_id").alias("dataset_id"), F.explode(F.concat(
        F.transform("feature_columns", lambda c: F.struct(F.lit("test_missing_feature").alias("problem"), c.alias("column_name"))),
        F.array(F.struct(F.lit("test_missing_target").alias("problem"), F.col("target_column").alias("column_name"))))).alias("c"))
    tested = tested.select("request_id", "dataset_id", "c.problem", "c.column_name").join(
        cat.select("dataset_id", "column_name"), ["dataset_id", "column_name"], "left_anti").select("request_id", "problem", "column_name")
    return missing.unionByName(targets).unionByName(tested)


def request_audit(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Violations of the request contract: algorithm vs problem type, hyper-parameters
    outside the algorithm's whitelist, l1 with lbfgs, bounds and enumerations.
    Output: request_id, problem, detail."""
    r = requests
    algo = F.col("algorithm")
    mismatch = (F.when((F.col("problem_type") == "classification") & ~is_classifier(algo), F.lit("classification_needs_classifier"))
                .when((F.col("problem_type") == "regression") & is_classifier(algo), F.lit("regression_with_classifier")))
    penalty = F.lower(F.col("hyperparameters")["penalty"])
    solver = F.lower(F.col("hyperparameters")["solver"])
    checks = [
        (F.when(~algo.isin(*ALGORITHMS), F.lit("bad_algorithm")), algo),
        (F.when(~F.col("problem_type").isin(*PROBLEM_TYPES), F.lit("bad_problem_type")), F.col("problem_type")),
        (mismatch, algo),
        (F.when((algo == "logistic_regression") & (penalty == "l1") & (solver == "lbfgs"), F.lit("l1_with_lbfgs")),
         F.lit("penalty=l1,solver=lbfgs")),
        (F.when(~F.col("cv_folds").between(2, 10), F.lit("cv_folds_out_of_range")), F.col("cv_folds").cast("string")),
        (F.when(~F.col("svd_components").between(2, 100), F.lit("svd_components_out_of_range")),
         F.col("svd_components").cast("string")),
        (F.when(F.size("feature_columns") < 1, F.lit("no_features")), F.lit("")),
        (F.when(~F.length("model_name").between(2, 80), F.lit("model_name_length")), F.col("model_name")),
        (F.when(~F.col("numeric_imputer").isin(*NUMERIC_IMPUTERS), F.lit("bad_numeric_imputer")),
         F.col("numeric_imputer")),
        (F.when(~F.col("categorical_imputer").isin(*CATEGORICAL_IMPUTERS), F.lit("bad_categorical_imputer")),
         F.col("categorical_imputer")),
        (F.when(~F.col("dimension_reduction").isin(*REDUCTIONS), F.lit("bad_dimension_reduction")),
         F.col("dimension_reduction")),
    ]
    row_checks = r.select("request_id", F.explode(F.array(*[
        F.struct(p.alias("problem"), d.alias("detail")) for p, d in checks])).alias("c")) \
        .select("request_id", "c.problem", "c.detail").filter(F.col("problem").isNotNull())
    params = r.select("request_id", "algorithm", F.explode(F.map_keys("hyperparameters")).alias("param"))
    bad_params = (params.join(allowed, ["algorithm", "param"], "left_anti")
                  .select("request_id", F.lit("hyperparameter_not_allowed").alias("problem"),
                          F.col("param").alias("detail")))
    return row_checks.unionByName(bad_params)


def resolve_ground_truth(scoring: DataFrame, catalogue: DataFrame) -> DataFrame:
    """V5-V7 for a table of scoring requests: '' disables evaluation; a given name is
    used; otherwise the manifest target when the dataset carries it. A resolved name that
    is a feature or absent from the dataset is an error status.
    Output: request_id, ground_truth, status."""
    cat = catalogue.select("dataset_id", "column_name", F.lit(True).alias("_present"))
    t = scoring.join(cat.withColumnRenamed("column_name", "manifest_target")
                     .withColumnRenamed("_present", "_target_present"), ["dataset_id", "manifest_target"], "left")
    chosen = (F.when(F.col("ground_truth_arg") == "", F.lit(None).cast("string"))
              .when(F.col("ground_truth_arg").isNotNull(), F.col("ground_truth_arg"))
              .when(F.col("_target_present"), F.col("manifest_target")))
    t = t.withColumn("ground_truth", chosen)
    t = t.join(cat.withColumnRenamed("column_name", "ground_truth"), ["dataset_id", "ground_truth"], "left")
    status = (F.when(F.col("ground_truth").isNull(), F.lit("disabled"))
              .when(F.array_contains("feature_columns", F.col("ground_truth")), F.lit("ground_truth_is_feature"))
              .when(F.col("_present").isNull(), F.lit("ground_truth_not_found"))
              .otherwise(F.lit("ok")))
    return t.select("request_id", "ground_truth", status.alias("status"))


def ground_truth_candidates(scoring: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per scoring request, the dataset's non-feature columns are candidates; the
    auto-detected one is the manifest target when it is a candidate, else the last
    candidate by position, else none. Output: request_id, candidate_count, auto_detected."""
    cand = (scoring.select("request_id", "dataset_id", "feature_columns", "manifest_target")
            .join(catalogue.select("dataset_id", "position", "column_name"), "dataset_id")
            .filter(~F.array_contains("feature_columns", F.col("column_name"))))
    agg = cand.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.max(F.when(F.col("column_name") == F.col("manifest_target"), F.col("column_name"))).alias("_t"),
        F.max_by("column_name", "position").alias("_last"))
    return agg.select("request_id", "candidate_count", F.coalesce("_t", "_last").alias("auto_detected"))
