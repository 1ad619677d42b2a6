"""AdaBoost over Spark ML decision trees with a weight column.

Regression is AdaBoost.R2 (Drucker 1997) with linear / square / exponential loss and
a weighted-median prediction; classification is SAMME (Zhu et al. 2009). Sample
weights are used directly by the tree learner (``weightCol``) instead of resampling.
Each round is one tree fit plus one or two aggregates; the weighted frame is persisted
each round and checkpointed every ``checkpoint_interval`` rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


@dataclass
class AdaBoostModel:
    kind: str                       # "r2" | "samme"
    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    num_classes: int = 2

    def _stage_predictions(self, df: DataFrame, features_col: str) -> DataFrame:
        out = df
        for t, tree in enumerate(self.trees):
            m = tree.copy()
            m.setFeaturesCol(features_col)
            m.setPredictionCol(f"_ab{t}")
            if hasattr(m, "setProbabilityCol"):
                m.setProbabilityCol(f"_abprob{t}")
                m.setRawPredictionCol(f"_abraw{t}")
            out = m.transform(out)
            out = out.drop(*[c for c in (f"_abprob{t}", f"_abraw{t}") if c in out.columns])
        return out

    def transform(self, df: DataFrame, features_col: str = "features", prediction_col: str = "prediction",
                  probability_col: str = "probability") -> DataFrame:
        staged = self._stage_predictions(df, features_col)
        T = len(self.trees)
        preds = [F.col(f"_ab{t}") for t in range(T)]
        w = [F.lit(float(x)) for x in self.weights]
        if self.kind == "r2":
            pairs = F.array_sort(F.array(*[F.struct(p.alias("p"), wt.alias("w")) for p, wt in zip(preds, w)]))
            half = 0.5 * sum(self.weights)
            # first sorted prediction whose cumulative weight reaches half the total
            acc = F.aggregate(pairs, F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("med")),
                              lambda a, e: F.struct((a["cum"] + e["w"]).alias("cum"),
                                                    F.when(a["med"].isNull() & (a["cum"] + e["w"] >= F.lit(half)),
                                                           e["p"]).otherwise(a["med"]).alias("med")))
            out = staged.withColumn(prediction_col, acc["med"])
        else:
            K = self.num_classes
            total = sum(self.weights) or 1.0
            score = [sum((F.when(p == F.lit(float(k)), wt).otherwise(F.lit(0.0)) for p, wt in zip(preds, w)),
                         F.lit(0.0)) / F.lit(total) for k in range(K)]
            if K == 2:
                d = score[1] - score[0]
                p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-d))
                probs = F.array(F.lit(1.0) - p1, p1)
            else:
                dec = [(F.lit(float(K)) * s - F.lit(1.0)) / F.lit(float(K - 1)) / F.lit(float(K - 1)) for s in score]
                mx = F.greatest(*dec)
                ex = [F.exp(d - mx) for d in dec]
                tot = sum(ex[1:], ex[0])
                probs = F.array(*[e / tot for e in ex])
            best = F.array_position(F.array(*score), F.array_max(F.array(*score))) - 1
            out = staged.withColumn(probability_col, probs).withColumn(prediction_col, best.cast("double"))
        return out.drop(*[f"_ab{t}" for t in range(T)])


def _cut_lineage(data: DataFrame, t: int, interval: int, prev):
    """Persist (or every ``interval`` rounds checkpoint) the new weighted frame, and
    materialise it before its parent is released so the parent is never recomputed."""
    if (t + 1) % interval == 0:
        data = data.checkpoint(eager=True)
    else:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        data.count()
    if prev is not None:
        prev.unpersist()
    return data


def fit_adaboost_r2(df: DataFrame, features_col: str, label_col: str, n_estimators: int = 50,
                    learning_rate: float = 1.0, loss: str = "linear", max_depth: int = 3, seed: int = 42,
                    checkpoint_interval: int = 5) -> AdaBoostModel:
    checkpoint_dir(df.sparkSession)
    if loss not in ("linear", "square", "exponential"):
        raise ValueError("loss must be linear, square or exponential")
    data = df.select(F.col(features_col).alias("features"), F.col(label_col).cast("double").alias("label"),
                     F.lit(1.0).alias("_w")).checkpoint(eager=True)
    model = AdaBoostModel("r2")
    prev = None
    for t in range(n_estimators):
        tree = DecisionTreeRegressor(maxDepth=max_depth, weightCol="_w", seed=seed + t).fit(data)
        scored = tree.transform(data).withColumn("_e", F.abs(F.col("prediction") - F.col("label")))
        s = scored.agg(F.max("_e").alias("D"), F.sum("_w").alias("W"),
                       F.sum(F.col("_w") * F.col("_e")).alias("We"),
                       F.sum(F.col("_w") * F.col("_e") * F.col("_e")).alias("We2")).first()
        D, W = s["D"] or 0.0, s["W"]
        if D <= 0:
            model.trees.append(tree)
            model.weights.append(1.0)
            break
        if loss == "linear":
            lbar, L = s["We"] / (D * W), F.col("_e") / F.lit(D)
        elif loss == "square":
            lbar, L = s["We2"] / (D * D * W), (F.col("_e") / F.lit(D)) ** 2
        else:
            L = F.lit(1.0) - F.exp(-F.col("_e") / F.lit(D))
            lbar = scored.agg(F.sum(F.col("_w") * L)).first()[0] / W
        if lbar >= 0.5:
            if not model.trees:
                model.trees.append(tree)
                model.weights.append(1.0)
            break
        beta = lbar / (1.0 - lbar)
        model.trees.append(tree)
        model.weights.append(learning_rate * math.log(1.0 / beta))
        nxt = scored.select("features", "label",
                            (F.col("_w") * F.pow(F.lit(beta), (F.lit(1.0) - L) * F.lit(learning_rate)) / F.lit(W))
                            .alias("_w"))
        data = _cut_lineage(nxt, t, checkpoint_interval, prev)
        prev = data
    return model


def fit_adaboost_samme(df: DataFrame, features_col: str, label_col: str, num_classes: int,
                       n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 1, seed: int = 42,
                       checkpoint_interval: int = 5) -> AdaBoostModel:
    checkpoint_dir(df.sparkSession)
    K = num_classes
    data = df.select(F.col(features_col).alias("features"), F.col(label_col).cast("double").alias("label"),
                     F.lit(1.0).alias("_w")).checkpoint(eager=True)
    model = AdaBoostModel("samme", num_classes=K)
    prev = None
    for t in range(n_estimators):
        tree = DecisionTreeClassifier(maxDepth=max_depth, weightCol="_w", seed=seed + t).fit(data)
        scored = tree.transform(data).withColumn("_bad", (F.col("prediction") != F.col("label")).cast("double"))
        s = scored.agg(F.sum("_w").alias("W"), F.sum(F.col("_w") * F.col("_bad")).alias("Wb")).first()
        err = s["Wb"] / s["W"]
        if err <= 0:
            model.trees.append(tree)
            model.weights.append(1.0)
            break
        if err >= 1.0 - 1.0 / K:
            if not model.trees:
                model.trees.append(tree)
                model.weights.append(1.0)
            break
        alpha = learning_rate * (math.log((1.0 - err) / err) + math.log(K - 1.0))
        model.trees.append(tree)
        model.weights.append(alpha)
        nxt = scored.select("features", "label",
                            (F.col("_w") * F.exp(F.lit(alpha) * F.col("_bad")) / F.lit(s["W"])).alias("_w"))
        data = _cut_lineage(nxt, t, checkpoint_interval, prev)
        prev = data
    return model
