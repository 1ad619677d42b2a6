"""Category numbers without a limit, and the vectors made of them."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import dictionary as D
from tessera.operators import prepare
from tessera.operators.train import TrainSpec, train


def _rows(n=3000):
    rnd = random.Random(2)
    return [(i, rnd.choice(["b", "a", "é", "", "中", "Z"]) if i % 9 else None, f"id-{i % 2900:05d}", rnd.random() if i % 5 else None, "f") for i in range(n)]


@pytest.mark.parametrize("parts", ["1", "8"])
def test_numbers_are_alphabetical_and_whole(spark, parts):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, c string, name string, x double, features string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        d = D.fit_dictionary(df, ["c", "name"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for j, c in ((1, "c"), (2, "name")):
        want = {v: i for i, v in enumerate(sorted({r[j] for r in rows if r[j] is not None}, key=lambda v: v.encode()))}
        assert {r.value: r.slot for r in d.rows(spark).filter(F.col("name") == c).collect()} == want and d.sizes[c] == len(want)
    out = d.decode(d.encode(df, "name", "slot"), "slot", "name", "back")
    assert out.filter("back = name").count() == len(rows)
    assert d.encode(spark.createDataFrame([("new",), (None,)], "c string"), "c", "slot").filter("slot is not null").count() == 0


def test_vectors_equal_a_loop(spark):
    rows = _rows(200)
    df = spark.createDataFrame(rows, "k long, c string, name string, x double, features string")
    d = D.fit_dictionary(df, ["c", "name"])
    for cats in (["c"], ["c", "name"], []):
        out = D.assemble(df, ["x", "k"], cats, d, out="v")
        assert out.columns == [*df.columns, "v"]
        got = {r.k: r.a for r in out.select("k", vector_to_array("v").alias("a")).collect()}
        for r in rows:
            want = [float("nan") if r[3] is None else r[3], float(r[0])]
            for c in cats:
                j = 1 if c == "c" else 2
                names = sorted({q[j] for q in rows if q[j] is not None}, key=lambda v: v.encode())
                want += [float(r[j] == v) for v in names]
            assert np.array_equal(np.asarray(got[r[0]]), np.asarray(want), equal_nan=True)


def test_a_near_unique_column_trains(spark):
    """12,000 categories, above the limit there used to be."""
    df = spark.range(0, 15000).select("id", F.concat(F.lit("v"), (F.col("id") % 12000).cast("string")).alias("name"),
                                      (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 2.0).alias("y"))
    res = train(df, TrainSpec(features=["name", "x"], target="y", algorithm="xgboost", key_cols=["id"], cv_folds=2,
                              hyperparameters={"n_estimators": "2", "max_depth": "3"}))
    assert res.oof.count() == 15000 and res.metrics.first()["r2"] > 0.5
    assert res.model.width() == 12001


def test_labels_encode_and_decode(spark):
    df = spark.createDataFrame([(i, f"label {i % 40}") for i in range(100)], "k long, y string")
    out, d = prepare.label_encode(df, "y")
    want = {v: float(i) for i, v in enumerate(sorted({f"label {i}" for i in range(40)}))}
    assert all(r.label_index == want[r.y] for r in out.collect()) and d.sizes["y"] == 40
    assert d.decode(out, "label_index", "y", "again").filter("again <> y").count() == 0
    with pytest.raises(Exception, match="missing label"):
        prepare.label_encode(df.unionByName(spark.createDataFrame([(1, None)], "k long, y string")), "y")[0].collect()
