"""Exact quantiles by distributed selection against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import order_stats, prepare, profile

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def _series():
    rnd = random.Random(6)
    n = 4000
    return {
        "normal": [rnd.gauss(0, 1) for _ in range(n)],
        "hot": [7.0 if rnd.random() < 0.7 else float(rnd.randrange(1000)) for _ in range(n)],
        "gaps": [None if rnd.random() < 0.9 else rnd.random() for _ in range(n)],
        "one": [None] * (n - 1) + [5.0],
        "none": [None] * n,
        "wide": [rnd.choice([1e300, -1e300, float("inf"), -0.0, 0.0, 2.0 ** 53]) for _ in range(n)],
        "two": [1.0 + i % 2 for i in range(n)],
    }


def _want(values):
    v = np.sort(np.asarray([x for x in values if x is not None]))
    out = []
    for p in PROBS:
        if not len(v):
            out.append(None)
            continue
        at = p * (len(v) - 1)
        lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
        out.append(lo if lo == hi else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi)
    return out


@pytest.mark.parametrize("accuracy,parts", [(10_000, 1), (10_000, 7), (100, 3), (10, 3), (1, 2)])
def test_quantiles_match_numpy(spark, accuracy, parts):
    series = _series()
    names = list(series)
    df = spark.createDataFrame(list(zip(*series.values())), ", ".join(f"{n} double" for n in names)).repartition(parts)
    got = order_stats.exact_quantiles(df, {n: F.col(n) for n in names}, PROBS, accuracy)
    for n in names:
        want = _want(series[n])
        assert all(a is None and b is None or a == b or abs(a - b) <= 1e-12 * abs(b) for a, b in zip(got[n], want)), (n, got[n], want)


def test_a_bracket_that_misses_is_opened(spark, monkeypatch):
    """The result does not depend on the sketch: here it names values far from the ranks."""
    monkeypatch.setattr(order_stats.F, "percentile_approx", lambda x, cuts, accuracy: F.array(*[F.max(x) for _ in cuts]))
    df = spark.range(0, 1001).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    assert order_stats.exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, [0.1, 0.5], 1000) == {"x": [100.0, 500.0], "y": [0.0, 1.0]}


def test_no_series_and_no_rows(spark):
    df = spark.createDataFrame([], "x double")
    assert order_stats.exact_quantiles(df, {}, [0.5]) == {}
    assert order_stats.exact_quantiles(df, {"x": F.col("x")}, [0.5, 0.9]) == {"x": [None, None]}


def test_no_value_map_in_the_plans(spark):
    df = spark.createDataFrame([(i, float(i % 17), i % 5) for i in range(300)], "k long, x double, fold int")
    for out in (profile.profile(df), prepare.impute_per_fold(df, "fold", 5, ["x"], [])):
        assert "percentile(" not in out._jdf.queryExecution().toString()


def test_medians_of_fold_complements(spark):
    rnd = random.Random(1)
    rows = [(i, None if i % 11 == 0 else rnd.choice([3.0, rnd.random()]), i % 4) for i in range(400)]
    out = prepare.impute_per_fold(spark.createDataFrame(rows, "k long, x double, fold int"), "fold", 4, ["x"], [])
    med = {f: float(np.median([x for _, x, g in rows if x is not None and g != f])) for f in range(4)}
    assert {r.k: r.x for r in out.collect()} == {k: med[f] if x is None else x for k, x, f in rows}
