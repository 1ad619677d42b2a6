"""Post-pruning of Spark ML forests for the growth limits Spark lacks.

Greedy top-down growth chooses each node's split without looking at its descendants,
so both limits can be applied after growth:
  * min_samples_split: a node with fewer (bagged) rows than the limit becomes a leaf;
  * max_leaf_nodes: best-first replay -- start from the root as the only leaf and keep
    expanding the leaf whose split removes the most weighted impurity until the leaf
    budget is used; the rest collapse.
The pruned forest is scored by the flat-tree walker (JVM, no Python per row). The tree
structure is read from the model's own saved node table (its size is the model's,
independent of the data).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.trees import FlatTrees
from tessera.session import scratch_path


def drop_summary(model):
    """``model`` without its training summary. A binary classifier's summary holds the session, and scoring sends the model to
    tasks: that fails once the session holds what cannot be sent (after ``DataFrame.observe``)."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(model._java_obj.getClass().getClassLoader().loadClass("scala.None$").getField("MODULE$").get(None))
    return model


def forest_nodes(model, spark) -> list[list[dict]]:
    """Nodes of every tree: id, left, right, feature, threshold, rawCount, impurity,
    prediction and the class distribution (classifiers)."""
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        split = r["split"]
        thr = split["leftCategoriesOrThreshold"][0] if split and split["leftCategoriesOrThreshold"] else 0.0
        trees.setdefault(r["treeID"], {})[r["id"]] = {
            "left": r["leftChild"], "right": r["rightChild"], "feat": split["featureIndex"] if split else -1,
            "thr": float(thr), "count": r["rawCount"], "impurity": r["impurity"], "prediction": r["prediction"],
            "stats": list(r["impurityStats"] or [])}
    return [trees[t] for t in sorted(trees)]


def prune_tree(nodes: dict[int, dict], min_samples_split: int | None, max_leaf_nodes: int | None) -> dict[int, dict]:
    def splittable(i):
        n = nodes[i]
        return n["left"] >= 0 and (min_samples_split is None or n["count"] >= min_samples_split)

    def gain(i):
        n = nodes[i]
        l, r = nodes[n["left"]], nodes[n["right"]]
        return n["count"] * n["impurity"] - l["count"] * l["impurity"] - r["count"] * r["impurity"]

    keep: set[int] = set()
    if max_leaf_nodes is None:
        stack = [0]
        while stack:
            i = stack.pop()
            if splittable(i):
                keep.add(i)
                stack += [nodes[i]["left"], nodes[i]["right"]]
    else:
        leaves, heap = 1, []
        if splittable(0):
            heapq.heappush(heap, (-gain(0), 0))
        while heap and leaves < max_leaf_nodes:
            _, i = heapq.heappop(heap)
            keep.add(i)
            leaves += 1
            for c in (nodes[i]["left"], nodes[i]["right"]):
                if splittable(c):
                    heapq.heappush(heap, (-gain(c), c))
    out = {}
    for i, n in nodes.items():
        m = dict(n)
        if i not in keep:
            m["left"] = m["right"] = -1
            m["feat"] = -1
        out[i] = m
    return out


def _local(nodes: dict[int, dict], value) -> list[dict]:
    """Renumber reachable nodes from the root into the FlatTrees local format."""
    order, index, stack = [], {}, [0]
    while stack:
        i = stack.pop()
        index[i] = len(order)
        order.append(i)
        n = nodes[i]
        if n["left"] >= 0:
            stack += [n["right"], n["left"]]
    out = []
    for i in order:
        n = nodes[i]
        leaf = n["left"] < 0
        out.append({"feat": -1 if leaf else n["feat"], "thr": n["thr"], "left": -1 if leaf else index[n["left"]],
                    "right": -1 if leaf else index[n["right"]], "value": value(n) if leaf else 0.0})
    return out


@dataclass
class PrunedForestModel:
    outputs: list[FlatTrees]       # one ensemble for regression, one per class otherwise
    classification: bool

    def transform(self, df: DataFrame, features_col: str = "features", prediction_col: str = "prediction",
                  probability_col: str = "probability") -> DataFrame:
        x = vector_to_array(F.col(features_col))
        vals = [t.predict_on_array(x) for t in self.outputs]
        if not self.classification:
            return df.withColumn(prediction_col, vals[0])
        probs = F.array(*vals)
        return (df.withColumn(probability_col, probs)
                .withColumn(prediction_col, (F.array_position(probs, F.array_max(probs)) - 1).cast("double")))


def prune_forest(model, spark, classification: bool, num_classes: int, min_samples_split: int | None,
                 max_leaf_nodes: int | None) -> PrunedForestModel:
    drop_summary(model)
    trees = [prune_tree(t, min_samples_split, max_leaf_nodes) for t in forest_nodes(model, spark)]
    w = 1.0 / max(len(trees), 1)
    if not classification:
        ens = FlatTrees(features=[])
        for t in trees:
            ens.add_tree(_local(t, lambda n: n["prediction"]), weight=w)
        return PrunedForestModel([ens], False)
    outs = []
    for k in range(num_classes):
        ens = FlatTrees(features=[])
        for t in trees:
            ens.add_tree(_local(t, lambda n, k=k: (n["stats"][k] / sum(n["stats"])) if len(n["stats"]) > k and sum(n["stats"]) else 0.0),
                         weight=w)
        outs.append(ens)
    return PrunedForestModel(outs, True)
