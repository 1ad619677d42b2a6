"""Scoring by a table of models: families, preprocessing, hot models and rejects."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import model_table as MT

TREE = {"feat": [0, -1, 1, -1, -1], "thr": [1.0, 0.0, 5.0, 0.0, 0.0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1],
        "value": [0.0, 10.0, 0.0, 20.0, 30.0], "roots": [0, 0]}
MODELS = [
    ("lin", "spark", "linear", ["a", "b"], [1.0, None], None, [2.0, 1.0], [3.0, -1.0], 0.5, None, None),
    ("log", "SKLEARN", "logistic", ["b"], None, [1.0], None, [2.0], 0.0, ["no", "yes"], None),
    ("tree", "spark", "trees", ["b", "c"], None, None, None, None, 1.0, None, TREE),
    ("old", "onnx", "linear", ["a"], None, None, None, [1.0], 0.0, None, None),
    ("odd", "spark", "svm", ["a"], None, None, None, [1.0], 0.0, None, None),
    ("bad", "spark", "linear", ["a"], None, None, None, [1.0, 2.0], 0.0, None, None),
    ("twice", "spark", "linear", ["a"], None, None, None, [1.0], 0.0, None, None),
    ("twice", "spark", "linear", ["a"], None, None, None, [2.0], 0.0, None, None),
]


def _want(model, x):
    a, b, c = x.get("a"), x.get("b"), x.get("c")
    if model == "lin":
        return ("missing_feature",) if b is None else (0.5 + 3.0 * ((1.0 if a is None else a) / 2.0) - b, None)
    if model == "log":
        if b is None:
            return ("missing_feature",)
        p = 1 / (1 + math.exp(-2.0 * (b - 1.0)))
        return p, "yes" if p > 0.5 else "no"
    if model == "tree":
        leaf = 10.0 if b is not None and b <= 1.0 else (20.0 if c is not None and c <= 5.0 else 30.0)
        return 1.0 + 2 * leaf, None
    return ({"old": "unsupported_framework", "odd": "unsupported_family", "bad": "broken_model", "twice": "ambiguous_model"}.get(model, "unknown_model"),)


@pytest.mark.parametrize("part_rows", [1_000_000, 40])
def test_every_row_is_scored_or_rejected(spark, part_rows):
    rnd = random.Random(4)
    names = ["lin"] * 12 + [m[0] for m in MODELS] + ["none", None]                  # one model has half of the rows
    rows = [(i, rnd.choice(names), {k: rnd.choice([None, rnd.uniform(0, 8)]) for k in rnd.sample("abcd", rnd.randrange(5))} if i % 50 else None, "x")
            for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, m string, inputs map<string,double>, parts string").repartition(5)
    out = MT.score_by_manifest(df, spark.createDataFrame(MODELS, MT.MODELS), key="row_id", model_col="m", part_rows=part_rows)
    got = {r.key: (r.prediction, r.label) for r in out.predictions.collect()}
    lost = {r.key: r.reason for r in out.rejects.collect()}
    assert len(got) + len(lost) == len(rows) and not set(got) & set(lost)
    for i, m, x, _ in rows:
        want = _want(m, x or {})
        if len(want) == 1:
            assert lost[i] == want[0]
        else:
            assert got[i][0] == pytest.approx(want[0]) and got[i][1] == want[1]


def test_no_rows_no_models_and_few_columns(spark):
    schema = "row_id long, model_id string, inputs map<string,double>"
    models = spark.createDataFrame([("m", "spark", "linear", ["a"], [2.0], 1.0)],
                                   "model_id string, framework string, family string, features array<string>, weights array<double>, intercept double")
    assert MT.score_by_manifest(spark.createDataFrame([], schema), models, key="row_id").predictions.count() == 0
    rows = spark.createDataFrame([(1, "m", {"a": 3.0}), (1, "m", {"a": 3.0}), (2, "n", {})], schema)
    out = MT.score_by_manifest(rows, models, key="row_id")
    assert [(r.key, r.prediction) for r in out.predictions.collect()] == [(1, 7.0), (1, 7.0)] and out.rejects.count() == 1
    none = MT.score_by_manifest(rows, models.limit(0), key="row_id")
    assert none.predictions.count() == 0 and none.rejects.filter(F.col("reason") == "unknown_model").count() == 3
