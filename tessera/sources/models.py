"""Model artifact save / load (S14, X9): the fitted preprocessing and estimator of a
training run under one folder. Spark ML parts use their own writers; the small
fitted values (fill values, labels, SVD components, boosted-tree arrays) are one JSON
document written through Spark, so any shared file system Spark can reach works."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.ml.classification import (DecisionTreeClassificationModel, GBTClassificationModel,
                                       LogisticRegressionModel, OneVsRestModel, RandomForestClassificationModel)
from pyspark.ml.regression import (DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel,
                                   RandomForestRegressionModel)
from pyspark.sql import SparkSession

from tessera.operators.adaboost import AdaBoostModel
from tessera.operators.boost import NewtonBoostModel, NewtonBoostParams
from tessera.operators.dictionary import Dictionary
from tessera.operators.prepare import ImputerModel
from tessera.operators.prune import PrunedForestModel
from tessera.operators.svd import SVDModel
from tessera.operators.train import FittedPipeline, TrainSpec, _CustomEstimatorModel
from tessera.operators.trees import FlatTrees

_TREE_FIELDS = ("feat", "thr", "left", "right", "value", "roots", "weights", "depth", "base")


def _flat_to_dict(t: FlatTrees) -> dict:
    return {k: getattr(t, k) for k in _TREE_FIELDS}


def _flat_from_dict(d: dict) -> FlatTrees:
    ft = FlatTrees(features=[])
    for k, v in d.items():
        setattr(ft, k, v)
    return ft


_SPARK_MODELS = {c.__name__: c for c in (GBTClassificationModel, LogisticRegressionModel, OneVsRestModel,
                                         RandomForestClassificationModel, GBTRegressionModel, LinearRegressionModel,
                                         RandomForestRegressionModel)}


def _write_json(spark: SparkSession, path: str, doc: dict) -> None:
    spark.createDataFrame([(json.dumps(doc, default=float),)], "doc string").coalesce(1) \
        .write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def save_pipeline(model: FittedPipeline, path: str, spark: SparkSession | None = None) -> str:
    spark = _session(spark)
    meta = {"spec": asdict(model.spec), "numeric": model.numeric, "categorical": model.categorical,
            "fills": model.imputer.fills, "drop_cols": list(model.imputer.drop_cols), "labels": model.labels,
            "svd": None if model.svd is None else {"components": model.svd.components.tolist(),
                                                   "singular_values": model.svd.singular_values.tolist()}}
    if model.dictionary is not None:
        model.dictionary.rows(spark).write.mode("overwrite").parquet(f"{path}/dictionary")
        meta["dictionary"] = {"sizes": model.dictionary.sizes, "widths": model.dictionary.widths}
    est = model.estimator
    if isinstance(est, _CustomEstimatorModel):
        inner = est.model
        if isinstance(inner, NewtonBoostModel):
            meta["estimator"] = {"kind": "newton", "params": asdict(inner.params), "n_features": inner.n_features,
                                 "edges": inner.edges, "base": inner.base,
                                 "trees": [_flat_to_dict(t) for t in inner.trees]}
        elif isinstance(inner, PrunedForestModel):
            meta["estimator"] = {"kind": "pruned_forest", "classification": inner.classification,
                                 "outputs": [_flat_to_dict(t) for t in inner.outputs]}
        else:
            meta["estimator"] = {"kind": "adaboost", "ab_kind": inner.kind, "weights": inner.weights,
                                 "num_classes": inner.num_classes, "n": len(inner.trees),
                                 "tree_class": type(inner.trees[0]).__name__ if inner.trees else None}
            for i, t in enumerate(inner.trees):
                t.write().overwrite().save(f"{path}/tree_{i}")
    else:
        meta["estimator"] = {"kind": "spark", "class": type(est).__name__}
        est.write().overwrite().save(f"{path}/estimator")
    _write_json(spark, f"{path}/meta", meta)
    return path


def load_pipeline(path: str, spark: SparkSession | None = None) -> FittedPipeline:
    spark = _session(spark)
    meta = _read_json(spark, f"{path}/meta")
    spec = TrainSpec(**meta["spec"])
    dictionary = Dictionary(f"{path}/dictionary", **meta["dictionary"]) if meta["categorical"] else None
    svd = None
    if meta["svd"]:
        svd = SVDModel(np.asarray(meta["svd"]["components"]), np.asarray(meta["svd"]["singular_values"]))
    e = meta["estimator"]
    if e["kind"] == "spark":
        est = _SPARK_MODELS[e["class"]].load(f"{path}/estimator")
    elif e["kind"] == "newton":
        trees = [_flat_from_dict(t) for t in e["trees"]]
        est = _CustomEstimatorModel(NewtonBoostModel(NewtonBoostParams(**e["params"]), e["n_features"], e["edges"],
                                                     e["base"], trees))
    elif e["kind"] == "pruned_forest":
        est = _CustomEstimatorModel(PrunedForestModel([_flat_from_dict(t) for t in e["outputs"]],
                                                      e["classification"]))
    else:
        cls = DecisionTreeRegressionModel if e["tree_class"] == "DecisionTreeRegressionModel" \
            else DecisionTreeClassificationModel
        ab = AdaBoostModel(e["ab_kind"], [cls.load(f"{path}/tree_{i}") for i in range(e["n"])], e["weights"],
                           e["num_classes"])
        est = _CustomEstimatorModel(ab)
    imputer = ImputerModel(meta["fills"], tuple(meta["drop_cols"]))
    return FittedPipeline(spec, meta["numeric"], meta["categorical"], imputer, dictionary, svd, est,
                          meta["labels"])
