"""Flat decision trees scored on the JVM.

A tree (or an ensemble) is stored as parallel arrays: split feature index, threshold,
left child, right child, and a leaf value. Scoring walks the tree with the SQL
higher-order function ``aggregate`` over a fixed number of steps (the depth), so the
expression does not grow with depth and no Python runs per row. Rows go left when
``x <= threshold`` (the convention of Spark ML continuous splits).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import col


@dataclass
class FlatTrees:
    features: list[str]                    # model input columns, in index order
    feat: list[int] = field(default_factory=list)     # -1 marks a leaf
    thr: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)  # leaf output (internal nodes: unused)
    roots: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    depth: int = 0
    base: float = 0.0                      # constant added to the weighted sum

    # ------------------------------------------------------------ building
    def add_node(self, feat: int, thr: float, value: float) -> int:
        self.feat.append(int(feat))
        self.thr.append(float(thr))
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(float(value))
        return len(self.feat) - 1

    def add_tree(self, nodes: list[dict], weight: float = 1.0) -> None:
        """``nodes``: list of {feat, thr, left, right, value} with local child indices
        (-1 for none); node 0 is the root."""
        off = len(self.feat)
        depth = _depth(nodes)
        for n in nodes:
            self.feat.append(int(n["feat"]) if n["left"] >= 0 else -1)
            self.thr.append(float(n.get("thr", 0.0)))
            self.left.append(n["left"] + off if n["left"] >= 0 else -1)
            self.right.append(n["right"] + off if n["right"] >= 0 else -1)
            self.value.append(float(n.get("value", 0.0)))
        self.roots.append(off)
        self.weights.append(float(weight))
        self.depth = max(self.depth, depth)

    # ------------------------------------------------------------ scoring
    def _arrays(self):
        # each array is ONE literal (not an array of literals): plans stay small and the
        # generated code references the value instead of inlining every element
        return (_ints(self.feat), _doubles(self.thr), _ints(self.left), _ints(self.right), _doubles(self.value))

    def leaf_expr(self, root: Column, x: Column) -> Column:
        feat, thr, left, right, _ = self._arrays()
        steps = F.array_repeat(F.lit(0), max(self.depth, 1))

        def step(node, _):
            i = node + 1
            f = F.element_at(feat, i)
            go_left = F.element_at(x, f + 1) <= F.element_at(thr, i)
            nxt = F.when(go_left, F.element_at(left, i)).otherwise(F.element_at(right, i))
            return F.when(f < 0, node).otherwise(nxt)

        return F.aggregate(steps, root, step)

    def predict_expr(self) -> Column:
        """Weighted sum over trees of the leaf values, plus ``base``."""
        x = F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in self.features])
        value = self._arrays()[4]
        pairs = F.arrays_zip(_ints(self.roots).alias("r"), _doubles(self.weights).alias("w"))
        total = F.aggregate(pairs, F.lit(0.0),
                            lambda acc, t: acc + t["w"] * F.element_at(value, self.leaf_expr(t["r"], x) + 1))
        return total + F.lit(float(self.base))

    def leaf_on_array(self, root: Column, arr: Column) -> Column:
        """Leaf index reached from ``root`` for a row whose inputs are the array ``arr``."""
        return self.leaf_expr(root, F.transform(arr, lambda v: v.cast("double")))

    def predict_on_array(self, arr: Column) -> Column:
        """Weighted sum of leaf values over all trees for inputs given as one array column."""
        if not self.roots:
            return F.lit(0.0)
        x = F.transform(arr, lambda v: v.cast("double"))
        value = self._arrays()[4]
        pairs = F.arrays_zip(_ints(self.roots).alias("r"), _doubles(self.weights).alias("w"))
        return F.aggregate(pairs, F.lit(0.0),
                           lambda acc, t: acc + t["w"] * F.element_at(value, self.leaf_expr(t["r"], x) + 1)) \
            + F.lit(float(self.base))

    def predict(self) -> Column:
        return self.predict_expr()


def _ints(xs) -> Column:
    return F.lit([int(x) for x in xs]).cast("array<int>") if xs else F.array().cast("array<int>")


def _doubles(xs) -> Column:
    return F.lit([float(x) for x in xs]).cast("array<double>") if xs else F.array().cast("array<double>")


def _depth(nodes: list[dict]) -> int:
    best, stack = 0, [(0, 0)]
    while stack:
        i, d = stack.pop()
        n = nodes[i]
        if n["left"] < 0:
            best = max(best, d)
        else:
            stack.append((n["left"], d + 1))
            stack.append((n["right"], d + 1))
    return best


@dataclass
class Stump:
    """One split on one feature, with the two leaf outputs (numbers or labels)."""
    feature: str
    threshold: float
    left_value: object
    right_value: object

    def predict(self) -> Column:
        return F.when(col(self.feature).cast("double") <= F.lit(float(self.threshold)),
                      F.lit(self.left_value)).otherwise(F.lit(self.right_value))
