"""Training (E1-E11, C3-C8, F1-F11): preprocessing + estimator, k-fold out-of-fold
evaluation, refit on all usable rows.

Every fold fits its own preprocessing on the other folds (no leakage). The k fold
fits are submitted from a small driver thread pool, so their Spark jobs run side by
side on the cluster; each fold's held-out rows are scored by its own model and the k
scored slices are unioned into the out-of-fold table (k + 1 fits in total).
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.operators import metrics as M
from tessera.operators.adaboost import fit_adaboost_r2, fit_adaboost_samme
from tessera.operators.boost import NewtonBoostParams, fit_newton_boost
from tessera.operators.dictionary import Dictionary, assemble, fit_dictionary
from tessera.operators.folds import kfold_assign, stratified_kfold_assign
from tessera.operators.prepare import ImputerModel, fit_imputer, split_features
from tessera.operators.prune import drop_summary, prune_forest
from tessera.operators.svd import SVDModel, fit_truncated_svd
from tessera.operators.validate import drop_null_features, drop_null_target

REGRESSORS = ("random_forest", "gradient_boosting", "xgboost", "adaboost", "linear_regression")
CLASSIFIERS = ("random_forest_classifier", "gradient_boosting_classifier", "xgboost_classifier",
               "adaboost_classifier", "logistic_regression")

ROWS_PER_TASK = 100_000      # of a training table


@dataclass
class TrainSpec:
    features: list[str]
    target: str
    problem_type: str = "regression"
    algorithm: str = "random_forest"
    numeric_imputer: str = "median"
    categorical_imputer: str = "most_frequent"
    numeric_constant: float = 0.0
    categorical_constant: str = "Missing"
    cv_folds: int = 5
    dimension_reduction: str = "none"
    svd_components: int = 10
    hyperparameters: dict = field(default_factory=dict)
    key_cols: list[str] | None = None
    seed: int = 42

    @property
    def classification(self) -> bool:
        return self.problem_type == "classification"

    def check(self) -> None:
        """Argument checks (the same rules the request audit applies to tables)."""
        is_clf = self.algorithm.endswith("_classifier") or self.algorithm == "logistic_regression"
        if self.classification and not is_clf:
            raise ValueError("classification needs a classifier algorithm")
        if not self.classification and is_clf:
            raise ValueError("regression cannot use a classifier algorithm")
        if not 2 <= self.cv_folds <= 10:
            raise ValueError("cv_folds must be between 2 and 10")
        if not 2 <= self.svd_components <= 100:
            raise ValueError("svd_components must be between 2 and 100")
        if not self.features:
            raise ValueError("at least one feature is required")
        if self.target in self.features:
            raise ValueError("the target cannot also be a feature")
        from tessera.operators.contract import ALLOWED_PARAMS
        allowed = ALLOWED_PARAMS.get(self.algorithm, ())
        bad = set(self.hyperparameters) - set(allowed)
        if self.algorithm != "linear_regression" and bad:
            raise ValueError(f"unsupported hyper-parameters: {', '.join(sorted(bad))}")
        for name, least, open_ in (("n_estimators", 1, False), ("max_depth", 1, False), ("learning_rate", 0, True),
                                   ("subsample", 0, True), ("C", 0, True)):
            v = _num(self.hyperparameters.get(name))
            if v is not None and (v < least or (open_ and v == least)):
                raise ValueError(f"{name} must be {'above' if open_ else 'at least'} {least}")
        if "forest" in self.algorithm and (_num(self.hyperparameters.get("max_depth")) or 0) > 30:
            raise ValueError("forests grow to a depth of at most 30")
        if self.algorithm == "logistic_regression":
            pen = str(self.hyperparameters.get("penalty", "l2")).lower()
            sol = str(self.hyperparameters.get("solver", "liblinear" if pen == "l1" else "lbfgs")).lower()
            if pen not in ("l1", "l2"):
                raise ValueError("penalty must be l1 or l2")
            if pen == "l1" and sol == "lbfgs":
                raise ValueError("l1 penalty needs the liblinear or saga solver")


def _num(v, cast=float):
    if v is None:
        return None
    if cast is int:
        return int(float(v))
    return float(v)


# ------------------------------------------------------------------ fitted pipeline

@dataclass
class FittedPipeline:
    spec: TrainSpec
    numeric: list[str]
    categorical: list[str]
    imputer: ImputerModel
    dictionary: Dictionary | None
    svd: SVDModel | None
    estimator: object
    labels: list[str] | None

    def features(self, df: DataFrame) -> DataFrame:
        x = self.imputer.transform(df)
        if self.categorical:
            x = assemble(x, self.numeric, self.categorical, self.dictionary)
        else:
            x = VectorAssembler(inputCols=list(self.numeric), outputCol="features", handleInvalid="keep").transform(x)
        return x if self.svd is None else self.svd.transform(x, "features", "features")

    def width(self) -> int:
        """Length of the feature vector: numeric columns, then one slot per seen category
        of each categorical column (an unknown one has none), or the SVD rank."""
        if self.svd is not None:
            return int(self.svd.components.shape[0])
        n = len(self.numeric)
        if self.categorical:
            n += sum(self.dictionary.sizes[c] for c in self.categorical)
        return n

    def transform(self, df: DataFrame, prediction_col: str = "prediction") -> DataFrame:
        x = self.features(df)
        out = self.estimator.transform(x)
        out = out.drop(*[c for c in ("rawPrediction",) if c in out.columns])
        if self.labels is not None:
            lab = F.array(*[F.lit(v) for v in self.labels])
            out = out.withColumn("prediction_index", F.col("prediction")) \
                .withColumn("prediction", F.element_at(lab, F.col("prediction").cast("int") + 1))
            if "probability" in out.columns and dict(out.dtypes)["probability"] != "array<double>":
                out = out.withColumn("probability", vector_to_array(F.col("probability")))
        if prediction_col != "prediction":
            out = out.withColumnRenamed("prediction", prediction_col)
        return out.drop("features")


class _CustomEstimatorModel:
    """Adapter so custom models share the Spark ML ``transform`` signature."""

    def __init__(self, model):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df, "features")


def _estimator(spec: TrainSpec, n_rows: int, n_classes: int):
    hp = spec.hyperparameters
    a = spec.algorithm
    seed = spec.seed
    depth = _num(hp.get("max_depth"), int)
    if a in ("random_forest", "random_forest_classifier"):
        kw = dict(numTrees=_num(hp.get("n_estimators"), int) or 200, seed=seed,
                  maxDepth=depth or 30, featuresCol="features", labelCol="label")
        leaf = hp.get("min_samples_leaf")
        if leaf is not None:
            v = float(leaf)
            kw["minInstancesPerNode"] = max(1, int(math.ceil(v * n_rows)) if v < 1 else int(v))
        if a == "random_forest":
            return RandomForestRegressor(featureSubsetStrategy="all", **kw)
        return RandomForestClassifier(featureSubsetStrategy="sqrt", **kw)
    if a in ("gradient_boosting", "gradient_boosting_classifier"):
        kw = dict(maxIter=_num(hp.get("n_estimators"), int) or 100, stepSize=_num(hp.get("learning_rate")) or 0.1,
                  maxDepth=depth or 3, subsamplingRate=_num(hp.get("subsample")) or 1.0, seed=seed)
        if a == "gradient_boosting":
            return GBTRegressor(**kw)
        if n_classes <= 2:
            return GBTClassifier(**kw)
        return OneVsRest(classifier=GBTClassifier(**kw))
    if a == "logistic_regression":
        c = _num(hp.get("C")) or 1.0
        pen = str(hp.get("penalty", "l2")).lower()
        return LogisticRegression(maxIter=1000, regParam=1.0 / (c * max(n_rows, 1)),
                                  elasticNetParam=1.0 if pen == "l1" else 0.0, standardization=False,
                                  family="multinomial" if n_classes > 2 else "binomial")
    if a == "linear_regression":
        return LinearRegression(solver="normal", regParam=0.0)
    return None  # custom estimators are fitted by _fit_custom


def _fit_custom(spec: TrainSpec, data: DataFrame, n_features: int, n_classes: int, keys: list[str]):
    hp = spec.hyperparameters
    a = spec.algorithm
    if a in ("xgboost", "xgboost_classifier"):
        obj = "squared" if a == "xgboost" else ("logistic" if n_classes <= 2 else "softmax")
        params = NewtonBoostParams(objective=obj, n_estimators=_num(hp.get("n_estimators"), int) or 100,
                                   learning_rate=_num(hp.get("learning_rate")) or 0.3,
                                   max_depth=_num(hp.get("max_depth"), int) or 6,
                                   gamma=_num(hp.get("gamma")) or 0.0, subsample=_num(hp.get("subsample")) or 1.0,
                                   seed=spec.seed, num_class=max(n_classes, 1))
        return _CustomEstimatorModel(fit_newton_boost(data, "features", "label", params, n_features, keys))
    if a == "adaboost":
        return _CustomEstimatorModel(fit_adaboost_r2(
            data, "features", "label", n_estimators=_num(hp.get("n_estimators"), int) or 50,
            learning_rate=_num(hp.get("learning_rate")) or 1.0, loss=str(hp.get("loss", "linear")), seed=spec.seed))
    if a == "adaboost_classifier":
        return _CustomEstimatorModel(fit_adaboost_samme(
            data, "features", "label", max(n_classes, 2), n_estimators=_num(hp.get("n_estimators"), int) or 50,
            learning_rate=_num(hp.get("learning_rate")) or 1.0, seed=spec.seed))
    raise ValueError(f"unknown algorithm {a}")


def _maybe_prune(model, spec: TrainSpec, spark, n_rows: int, n_classes: int):
    """Forests with min_samples_split / max_leaf_nodes: prune after growth (Spark has no
    such growth limits) and score with the flat-tree walker."""
    hp = spec.hyperparameters
    if spec.algorithm not in ("random_forest", "random_forest_classifier"):
        return model
    mss, mln = hp.get("min_samples_split"), hp.get("max_leaf_nodes")
    if mss is None and mln is None:
        return model
    if mss is not None:
        v = float(mss)
        mss = int(math.ceil(v * n_rows)) if v < 1 else int(v)
    mln = int(float(mln)) if mln is not None else None
    return _CustomEstimatorModel(prune_forest(model, spark, spec.classification, n_classes, mss, mln))


def fit_pipeline(train: DataFrame, spec: TrainSpec, numeric: list[str], categorical: list[str],
                 labels: list[str] | None) -> FittedPipeline:
    """Fit preprocessing and the estimator on ``train`` (which carries a 'label' column)."""
    strategy = spec.numeric_imputer if spec.numeric_imputer != "drop" else "constant"
    imputer = fit_imputer(train, numeric, categorical, numeric_strategy=strategy,
                          categorical_strategy=spec.categorical_imputer, numeric_constant=spec.numeric_constant,
                          categorical_constant=spec.categorical_constant)
    if spec.numeric_imputer == "drop":
        imputer.fills = {k: v for k, v in imputer.fills.items() if k in categorical}
    x = imputer.transform(train)
    fp = FittedPipeline(spec, numeric, categorical, imputer, fit_dictionary(x, categorical) if categorical else None, None, None, labels)
    feats = fp.features(train)
    if spec.dimension_reduction == "truncated_svd":
        fp.svd = fit_truncated_svd(feats, "features", spec.svd_components)
        feats = fp.svd.transform(feats, "features", "features")
    keys = [c for c in spec.key_cols or [] if c not in ("features", "label") and c in feats.columns]
    feats = feats.select("features", "label", *keys).persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = feats.count()  # also materialises the cached training matrix
    n_classes = len(labels) if labels is not None else 0
    est = _estimator(spec, n_rows, n_classes)
    if est is not None:
        model = drop_summary(est.fit(feats))
        model = _maybe_prune(model, spec, feats.sparkSession, n_rows, n_classes)
    else:
        model = _fit_custom(spec, feats, fp.width(), n_classes, keys)
    fp.estimator = model
    feats.unpersist()
    return fp


# ------------------------------------------------------------------ training run

@dataclass
class TrainResult:
    model: FittedPipeline
    metrics: DataFrame
    oof: DataFrame
    test_metrics: DataFrame | None = None      # with an external test set


def prepare_training_frame(df: DataFrame, spec: TrainSpec):
    """V11/V12/V13 then the label: regression -> double; classification -> class index
    in alphabetical order of the class names (the names decode predictions)."""
    spec.check()
    data = drop_null_target(df, spec.target)
    if spec.numeric_imputer == "drop":
        data = drop_null_features(data, spec.features)
    numeric, categorical = split_features(data, spec.features)
    labels = None
    if spec.classification:
        lab = StringIndexer(inputCol=spec.target, outputCol="label", stringOrderType="alphabetAsc") \
            .fit(data.withColumn(spec.target, col(spec.target).cast("string")))
        labels = list(lab.labels)
        data = lab.transform(data.withColumn(spec.target, col(spec.target).cast("string")))
    else:
        y = col(spec.target).cast("double")
        if dict(data.dtypes)[spec.target] == "string":       # a target that is no number stops the run
            y = F.coalesce(F.trim(col(spec.target)).try_cast("double"), F.raise_error(F.lit(f"target '{spec.target}' must be numeric")).cast("double"))
        data = data.withColumn("label", y)
    return data, numeric, categorical, labels


def fit_partitions(data: DataFrame) -> int:
    """Partitions of a training table: a task slot each, more where that is over ROWS_PER_TASK rows."""
    return max(data.sparkSession.sparkContext.defaultParallelism, math.ceil(data.count() / ROWS_PER_TASK))


def train(df: DataFrame, spec: TrainSpec, parallelism: int | None = None, test: DataFrame | None = None) -> TrainResult:
    """Cross-validated metrics, out-of-fold rows and the model refitted on all rows; with ``test``, also
    its metrics on that table (whose columns are checked before anything is fitted)."""
    if test is not None:
        check_test_columns(test, spec)
    data, numeric, categorical, labels = prepare_training_frame(df, spec)
    # without declared key columns the whole row is the key, and identical rows may repeat
    keys = spec.key_cols or [c for c in df.columns]
    unique = spec.key_cols is not None
    k = spec.cv_folds
    if spec.classification:
        folded = stratified_kfold_assign(data, keys, "label", k=k, seed=spec.seed, unique_keys=unique)
    else:
        folded = kfold_assign(data, keys, k=k, seed=spec.seed, unique_keys=unique)
    # every pass of the k + 1 fits starts a task per partition of this table
    folded = folded.coalesce(fit_partitions(data)).persist(StorageLevel.MEMORY_AND_DISK)
    guards = folded.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest")).first()
    if (guards["rows"] or 0) < k:
        raise ValueError("not enough usable rows for the requested number of folds")
    if spec.classification and (guards["classes"] < 2 or guards["smallest"] < k):
        raise ValueError("classification needs two classes, each with at least cv_folds rows")

    def fold_fit(f):
        m = fit_pipeline(folded.filter(F.col("fold") != f), spec, numeric, categorical, labels)
        return m.transform(folded.filter(F.col("fold") == f))

    # the k fold fits and the final refit are independent: submit them together so their
    # jobs share the cluster instead of queueing one after another
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism or (k + 1), k + 1))) as pool:
        refit = pool.submit(fit_pipeline, folded, spec, numeric, categorical, labels)
        parts = list(pool.map(fold_fit, range(k)))
        model = refit.result()
    oof = parts[0]
    for part in parts[1:]:
        oof = oof.unionByName(part)
    return TrainResult(model, validation_metrics(oof, spec, labels), oof, None if test is None else external_metrics(model, test))


def validation_metrics(oof: DataFrame, spec: TrainSpec, labels: list[str] | None) -> DataFrame:
    if not spec.classification:
        return M.cv_regression_metrics(oof, "fold", "label", "prediction")
    out = M.cv_classification_metrics(oof.withColumn("_y", col(spec.target).cast("string")), "fold", "_y",
                                      "prediction")
    if labels is not None and len(labels) == 2 and "probability" in oof.columns:
        auc = M.roc_auc(oof.withColumn("_p1", F.col("probability")[1]), "label", "_p1")
        out = out.withColumn("roc_auc", auc.scalar())
    return out


def check_test_columns(test: DataFrame, spec: TrainSpec) -> None:
    gone = [c for c in spec.features + [spec.target] if c not in test.columns]
    if gone:
        raise ValueError("test set is missing columns: " + ", ".join(gone))


def external_metrics(model: FittedPipeline, test: DataFrame) -> DataFrame:
    """Score another table (missing features are filled by the imputers, not
    dropped) and report metrics; regression adds nrmse and the target mean."""
    spec = model.spec
    check_test_columns(test, spec)
    data = drop_null_target(test, spec.target)
    scored = model.transform(data)
    if spec.classification:
        return M.classification_metrics(scored.withColumn("_y", col(spec.target).cast("string")), "_y", "prediction")
    return M.regression_metrics(scored.withColumn("_y", col(spec.target).cast("double")), "_y", "prediction",
                                external=True)


def describe(model: FittedPipeline) -> str:
    """Small JSON description of the fitted pipeline (for records and logs)."""
    return json.dumps({"algorithm": model.spec.algorithm, "numeric": model.numeric,
                       "categorical": model.categorical, "labels": model.labels,
                       "fills": {k: v for k, v in model.imputer.fills.items()}}, default=str)
