"""Training queries (E1-E11, C3-C8, F8, F9, X9). Estimator outputs are checked by
rows (their SQL twin would be the algorithm itself); ``train_ols`` in q_folds has a
closed-form SQL twin.

Inputs: regression on part (p_retailprice from p_partkey, p_size, p_brand), binary
classification on labels joined to documents (quality from n_chars, lang, source),
multi-class vectors from embeddings.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators.folds import kfold_assign
from tessera.operators.svd import fit_truncated_svd
from tessera.operators.train import TrainSpec, external_metrics, fit_pipeline, prepare_training_frame, train
from tessera.plans.catalog import query
from tessera.plans.fixtures import ORDERS_NA_SQL, orders_na, table
from tessera.session import scratch_path


def part_frame(spark, sf_dir):
    """part with gaps: p_size missing when p_partkey % 9 = 0, p_brand when % 11 = 0."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"),
                    F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("p_brand"),
                    "p_retailprice")


def docs_frame(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(docs, "doc_id")


def _reg(algorithm, **hp):
    return TrainSpec(features=["p_partkey", "p_size", "p_brand"], target="p_retailprice", problem_type="regression",
                     algorithm=algorithm, hyperparameters=hp, key_cols=["p_partkey"])


def _clf(algorithm, **hp):
    return TrainSpec(features=["n_chars", "lang", "source"], target="quality", problem_type="classification",
                     algorithm=algorithm, hyperparameters=hp, key_cols=["doc_id"])


def _run(df, spec):
    return train(df, spec).metrics


@query("train_random_forest")
def q_train_random_forest(spark, sf_dir):
    return _run(part_frame(spark, sf_dir), _reg("random_forest", n_estimators="20", max_depth="8"))


@query("train_random_forest_classifier")
def q_train_random_forest_classifier(spark, sf_dir):
    return _run(docs_frame(spark, sf_dir), _clf("random_forest_classifier", n_estimators="20", max_depth="6"))


@query("train_gradient_boosting")
def q_train_gradient_boosting(spark, sf_dir):
    return _run(part_frame(spark, sf_dir), _reg("gradient_boosting", n_estimators="20"))


@query("train_gbt_classifier")
def q_train_gbt_classifier(spark, sf_dir):
    return _run(docs_frame(spark, sf_dir), _clf("gradient_boosting_classifier", n_estimators="10"))


@query("train_newton_boost")
def q_train_newton_boost(spark, sf_dir):
    return _run(part_frame(spark, sf_dir), _reg("xgboost", n_estimators="8", max_depth="4", learning_rate="0.3",
                                                gamma="0.05", subsample="0.8"))


@query("train_newton_boost_classifier")
def q_train_newton_boost_classifier(spark, sf_dir):
    return _run(docs_frame(spark, sf_dir), _clf("xgboost_classifier", n_estimators="5", max_depth="3"))


@query("train_adaboost")
def q_train_adaboost(spark, sf_dir):
    return _run(part_frame(spark, sf_dir), _reg("adaboost", n_estimators="6", loss="square"))


@query("train_adaboost_classifier")
def q_train_adaboost_classifier(spark, sf_dir):
    return _run(docs_frame(spark, sf_dir), _clf("adaboost_classifier", n_estimators="6"))


@query("train_logistic_regression")
def q_train_logistic_regression(spark, sf_dir):
    return _run(docs_frame(spark, sf_dir), _clf("logistic_regression", C="1.0", penalty="l2"))


@query("train_bundled")
def q_train_bundled(spark, sf_dir):
    """The three bundled recipes re-run on tables: OLS (price), logistic (quality),
    50-tree forest (order status); one in-sample metric row per model."""
    from tessera.operators import metrics as M
    rows = []
    ols = TrainSpec(features=["p_partkey", "p_size"], target="p_retailprice", algorithm="linear_regression",
                    numeric_imputer="mean", key_cols=["p_partkey"])
    data, num, cat, labels = prepare_training_frame(part_frame(spark, sf_dir), ols)
    m = fit_pipeline(data, ols, num, cat, labels)
    r = M.regression_metrics(m.transform(data), "label", "prediction").select(
        F.lit("ols").alias("model"), F.col("rmse").alias("metric"))
    rows.append(r)
    lr = _clf("logistic_regression")
    data, num, cat, labels = prepare_training_frame(docs_frame(spark, sf_dir), lr)
    m = fit_pipeline(data, lr, num, cat, labels)
    rows.append(M.classification_metrics(m.transform(data).withColumn("_y", F.col("quality").cast("string")),
                                         "_y", "prediction").select(F.lit("logistic").alias("model"),
                                                                    F.col("accuracy").alias("metric")))
    rf = TrainSpec(features=["o_totalprice", "o_custkey"], target="o_orderstatus", problem_type="classification",
                   algorithm="random_forest_classifier", hyperparameters={"n_estimators": "50", "max_depth": "5"},
                   key_cols=["o_orderkey"])
    data, num, cat, labels = prepare_training_frame(orders_na(spark, sf_dir), rf)
    m = fit_pipeline(data, rf, num, cat, labels)
    rows.append(M.classification_metrics(m.transform(data).withColumn("_y", F.col("o_orderstatus")), "_y",
                                         "prediction").select(F.lit("forest").alias("model"),
                                                              F.col("accuracy").alias("metric")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("cv_scores")
def q_cv_scores(spark, sf_dir):
    """Per-fold scores of a forest on part (fold, rmse, mae, r2)."""
    from tessera.operators import metrics as M
    res = train(part_frame(spark, sf_dir), _reg("random_forest", n_estimators="10", max_depth="6"))
    return M.regression_metrics(res.oof, "label", "prediction", group_by=["fold"]).select("fold", "rmse", "mae", "r2")


@query("oof_probability")
def q_oof_probability(spark, sf_dir):
    """Out-of-fold probability of the second class (quality 1) from logistic regression."""
    res = train(docs_frame(spark, sf_dir), _clf("logistic_regression"))
    return res.oof.select("doc_id", "fold", "quality", F.round(F.col("probability")[1], 6).alias("proba_1"))


def _split(spark, sf_dir):
    p = kfold_assign(part_frame(spark, sf_dir), ["p_partkey"], k=5)
    return p.filter(F.col("fold") != 0).drop("fold"), p.filter(F.col("fold") == 0).drop("fold")


@query("external_test")
def q_external_test(spark, sf_dir):
    """Train on four fifths of part, then score the held-out fifth as an external set."""
    train_df, test_df = _split(spark, sf_dir)
    res = train(train_df, _reg("gradient_boosting", n_estimators="10"))
    return external_metrics(res.model, test_df)


@query("evaluate_external")
def q_evaluate_external(spark, sf_dir):
    """A saved model, reloaded, evaluated on a table whose p_size is missing more
    often (the fitted imputer fills it; rows are not dropped for it)."""
    from tessera.sources.models import load_pipeline, save_pipeline
    train_df, test_df = _split(spark, sf_dir)
    data, num, cat, labels = prepare_training_frame(train_df, _reg("random_forest", n_estimators="10", max_depth="6"))
    m = fit_pipeline(data, _reg("random_forest", n_estimators="10", max_depth="6"), num, cat, labels)
    path = save_pipeline(m, scratch_path(spark, "model"))
    test = test_df.withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("p_size")))
    return external_metrics(load_pipeline(path), test)


@query("model_save_load")
def q_model_save_load(spark, sf_dir):
    """Predictions of a fitted pipeline before and after a save/load round trip."""
    from tessera.sources.models import load_pipeline, save_pipeline
    spec = _reg("xgboost", n_estimators="4", max_depth="3")
    data, num, cat, labels = prepare_training_frame(part_frame(spark, sf_dir), spec)
    m = fit_pipeline(data, spec, num, cat, labels)
    again = load_pipeline(save_pipeline(m, scratch_path(spark, "model")))
    a = m.transform(data).select("p_partkey", F.col("prediction").alias("before"))
    b = again.transform(data).select("p_partkey", F.col("prediction").alias("after"))
    return a.join(b, "p_partkey").withColumn("same", F.abs(F.col("before") - F.col("after")) < 1e-9)


@query("truncated_svd")
def q_truncated_svd(spark, sf_dir):
    """uncentred truncated SVD of the embedding vectors, 8 components."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    svd = fit_truncated_svd(v, "features", 8)
    return svd.transform(v, "features", "svd").select("vec_id", vector_to_array("svd").alias("components"))


@query("truncated_svd_wide")
def q_truncated_svd_wide(spark, sf_dir):
    """F9 over as many columns as there are orders: customers' order dates (a column per date) and order counts."""
    from tessera.operators.dictionary import assemble, fit_dictionary
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"),
                                              F.col("o_custkey").cast("string").alias("customer"), (F.col("o_totalprice") / 100000.0).alias("price"))
    feats = assemble(o, ["price"], ["day", "customer"], fit_dictionary(o, ["day", "customer"]))
    svd = fit_truncated_svd(feats, "features", 3)
    return svd.transform(feats, "features", "svd").select("o_orderkey", vector_to_array("svd").alias("components"))


@query("assemble", f"""
WITH src AS (SELECT * FROM ({ORDERS_NA_SQL}) WHERE o_orderstatus IS NOT NULL),
f AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM src)) AS price,
             coalesce(CAST(o_custkey AS DOUBLE), (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM src)) AS cust,
             coalesce(o_orderpriority, (SELECT o_orderpriority FROM src WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS p FROM src),
c AS (SELECT list(DISTINCT p ORDER BY p) AS all_p FROM f)
SELECT o_orderkey, list_concat([price, cust], list_transform(all_p, lambda x: CASE WHEN x = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS features
FROM f, c""")
def q_assemble(spark, sf_dir):
    """F8: numeric block then one-hot block, after imputation (median / most frequent)."""
    spec = TrainSpec(features=["o_totalprice", "o_custkey", "o_orderpriority"], target="o_orderstatus",
                     problem_type="classification", algorithm="logistic_regression", key_cols=["o_orderkey"])
    data, num, cat, labels = prepare_training_frame(orders_na(spark, sf_dir), spec)
    from tessera.operators.prepare import fit_imputer
    from tessera.operators.train import FittedPipeline
    from tessera.operators.dictionary import fit_dictionary
    imp = fit_imputer(data, num, cat)
    fp = FittedPipeline(spec, num, cat, imp, fit_dictionary(imp.transform(data), cat), None, None, labels)
    return fp.features(data).select("o_orderkey", vector_to_array("features").alias("features"))




@query("train_random_forest_pruned")
def q_train_random_forest_pruned(spark, sf_dir):
    """E1 growth limits Spark lacks: min_samples_split and max_leaf_nodes, applied by
    post-pruning the fitted forest (scored by the flat-tree walker)."""
    return _run(part_frame(spark, sf_dir), _reg("random_forest", n_estimators="10", max_depth="8",
                                                min_samples_split="20", max_leaf_nodes="16"))


@query("train_random_forest_classifier_pruned")
def q_train_random_forest_classifier_pruned(spark, sf_dir):
    return _run(docs_frame(spark, sf_dir), _clf("random_forest_classifier", n_estimators="10", max_depth="6",
                                                min_samples_split="0.05", max_leaf_nodes="8"))


@query("train_newton_boost_multiclass")
def q_train_newton_boost_multiclass(spark, sf_dir):
    """E4/E6 multi-class: softmax Newton boosting on the embedding vectors (10 classes),
    reduced by truncated SVD inside each fold; string class names go through the label
    encoder (F10)."""
    e = table(spark, sf_dir, "embeddings")
    cols = [F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(64)]
    df = e.select("vec_id", F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label_name"), *cols)
    spec = TrainSpec(features=[f"e{i}" for i in range(64)], target="label_name", problem_type="classification",
                     algorithm="xgboost_classifier", dimension_reduction="truncated_svd", svd_components=6,
                     hyperparameters={"n_estimators": "3", "max_depth": "3"}, key_cols=["vec_id"])
    return _run(df, spec)
