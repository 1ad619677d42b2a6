"""The Newton booster against a plain numpy one, and its independence of partitioning."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from tessera.operators import boost
from tessera.operators.boost import Bins, NewtonBoostParams, fit_newton_boost


def _data(n=400, seed=3, classes=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rnd.gauss(0, 3), float(rnd.randrange(5)), 7.5 if rnd.random() < 0.8 else rnd.random(),
             float("nan") if rnd.random() < 0.2 else rnd.uniform(-1, 1), float(rnd.random() < 0.3)]
        s = x[0] + 2 * x[1] + (0 if math.isnan(x[3]) else 3 * x[3]) - 4 * x[4]
        y = float(s + rnd.gauss(0, 0.1)) if not classes else float(int(abs(s)) % classes)
        rows.append((i, x, y))
    return rows + rows[:60]                                      # repeated rows


def _frame(spark, rows):
    out = []
    for i, x, y in rows:
        kept = [j for j, v in enumerate(x) if v != 0]
        out.append((i, SparseVector(len(x), kept, [x[j] for j in kept]) if i % 2 else Vectors.dense(x), y))
    return spark.createDataFrame(out, ["key", "features", "label"])


def _plain(rows, edges, p, outputs, base):
    """Margins after all rounds, by loops over rows."""
    x, y = np.asarray([r[1] for r in rows]), np.asarray([r[2] for r in rows])
    bins = np.stack([np.where(np.isnan(x[:, f]), len(e) + 1, np.searchsorted(e, x[:, f], "right")) for f, e in enumerate(edges)], 1)
    m = np.tile(np.asarray(base), (len(rows), 1))
    for _ in range(p.n_estimators):
        if p.objective == "squared":
            g, h = m - y[:, None], np.ones_like(m)
        elif p.objective == "logistic":
            q = 1 / (1 + np.exp(-m))
            g, h = q - y[:, None], q * (1 - q)
        else:
            q = np.exp(m) / np.exp(m).sum(1, keepdims=True)
            g, h = q - (y[:, None] == np.arange(outputs)), 2 * q * (1 - q)
        step = np.zeros_like(m)
        for k in range(outputs):
            nodes = [(np.arange(len(rows)), 0)]
            while nodes:
                at, depth = nodes.pop()
                G, H = g[at, k].sum(), h[at, k].sum()
                best = (0.0, None)
                if depth < p.max_depth:
                    for f, e in enumerate(edges):
                        for b in range(len(e) + 1):
                            left = bins[at, f] <= b
                            gl, hl = g[at[left], k].sum(), h[at[left], k].sum()
                            if hl < p.min_child_weight or H - hl < p.min_child_weight:
                                continue
                            gain = 0.5 * (gl ** 2 / (hl + p.reg_lambda) + (G - gl) ** 2 / (H - hl + p.reg_lambda) - G ** 2 / (H + p.reg_lambda)) - p.gamma
                            if gain > best[0] + 1e-9:
                                best = (gain, left)
                if best[1] is None:
                    step[at, k] = -p.learning_rate * G / (H + p.reg_lambda)
                else:
                    nodes += [(at[best[1]], depth + 1), (at[~best[1]], depth + 1)]
        m = m + step
    return m


@pytest.mark.parametrize("objective,classes", [("squared", 0), ("logistic", 2), ("softmax", 3)])
def test_predictions_match_a_plain_booster(spark, objective, classes):
    rows = _data(classes=classes)
    p = NewtonBoostParams(objective=objective, n_estimators=3, max_depth=3, max_bins=8, checkpoint_interval=2, num_class=max(classes, 1),
                          gamma=0.01)
    df = _frame(spark, rows)
    m = fit_newton_boost(df, "features", "label", p, 5)
    want = _plain(rows, m.edges, p, len(m.trees), m.base)
    got = {r.key: r for r in m.transform(df.dropDuplicates(["key"])).collect()}
    for (i, _, _), w in zip(rows, want):
        r = got[i]
        if objective == "squared":
            assert r.prediction == pytest.approx(w[0], abs=1e-6)
        elif objective == "logistic":
            assert r.probability[1] == pytest.approx(1 / (1 + math.exp(-w[0])), abs=1e-6)
        else:
            assert r.probability == pytest.approx(list(np.exp(w) / np.exp(w).sum()), abs=1e-6)


def test_trees_do_not_depend_on_partitions(spark, monkeypatch):
    rows = _data(n=900, seed=9)
    p = NewtonBoostParams(n_estimators=4, max_depth=4, subsample=0.7, checkpoint_interval=2, max_bins=16)
    models = []
    for parts in (1, 5, 37):
        monkeypatch.setattr(boost, "BLOCK_ROWS", 1024 + 100 * parts)
        df = _frame(spark, random.Random(parts).sample(rows, len(rows))).repartition(parts)
        models.append(fit_newton_boost(df, "features", "label", p, 5, ["key"]))
    assert models[0].edges == models[1].edges == models[2].edges and models[0].base == models[1].base == models[2].base
    assert models[0].trees == models[1].trees == models[2].trees
    assert len(models[0].trees[0].roots) == 4 and models[0].trees[0].depth == 4


def test_edges_follow_quantiles_and_part_hot_values(spark):
    rnd = random.Random(5)
    n = 5000
    cols = [[rnd.gauss(0, 1) for _ in range(n)], [1000.0 + rnd.random() for _ in range(n)], [float(rnd.randrange(40)) for _ in range(n)],
            [3.0 if rnd.random() < 0.9 else rnd.random() * 1e-9 for _ in range(n)], [0.0] * n, [float("nan")] * n,
            [rnd.choice([float("nan"), -1.0, 0.0, 1.0]) for _ in range(n)], [float("inf") if rnd.random() < 0.5 else -rnd.random() for _ in range(n)]]
    df = spark.createDataFrame([(Vectors.dense(x), 0.0) for x in zip(*cols)], ["features", "label"]).repartition(4)
    rows = df.select(*boost._raw(F.col("features")))
    edges = boost.bin_edges(rows, len(cols), 32, n)
    for values, e in zip(cols[:2], edges[:2]):
        share = np.bincount(np.searchsorted(e, values, "right")) / n
        assert 25 <= len(e) < 32 and share.max() < 2.2 / 32
    assert edges[2] == sorted(edges[2]) and len(edges[2]) >= 25 and set(edges[2]) <= set(map(float, range(40)))
    assert 3.0 in edges[3] and edges[4] == [] and edges[5] == []
    assert edges[6] == [0.0, 1.0] and float("inf") in edges[7]


def test_codes_and_missing_values():
    bins = Bins.of([[0.5, 1.5], [], [-1.0]])
    assert bins.first.tolist() == [0, 4, 6, 9] and bins.zero.tolist() == [0, 4, 7]
    f = np.asarray([0, 0, 0, 0, 1, 2, 2, 1])
    v = np.asarray([0.5, 0.4, 9.0, np.nan, 3.0, -2.0, -1.0, np.nan])
    assert bins.codes(f, v).tolist() == [1, 0, 2, 3, 4, 6, 7, 5]


def test_no_rows_and_no_signal(spark):
    none = spark.createDataFrame([], "key long, label double").withColumn("features", F.lit(None))
    empty = _frame(spark, _data(5)).limit(0)
    m = fit_newton_boost(empty, "features", "label", NewtonBoostParams(n_estimators=2), 5)
    assert m.base == [0.0] and not m.trees[0].roots and none.count() == 0
    flat = _frame(spark, [(i, [1.0, 2.0], 4.0) for i in range(50)])
    m = fit_newton_boost(flat, "features", "label", NewtonBoostParams(n_estimators=2), 2)
    assert {r.prediction for r in m.transform(flat).collect()} == {4.0}
