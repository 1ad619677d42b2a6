"""Truncated SVD over more columns than a Gram matrix is made for."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors

from tessera.operators import svd


def _matrix(n=300, p=3000, seed=4):
    rng = np.random.default_rng(seed)
    a = (rng.standard_normal((n, 8)) * 2.0 ** -np.arange(8)) @ rng.standard_normal((8, p))
    a[:, rng.random(p) < 0.7] = 0
    return a + (rng.random((n, p)) < 0.001) * 0.05


def test_wide_values_and_projection_match_numpy(spark):
    a = _matrix()
    rows = []
    for i, x in enumerate(a):
        at = np.flatnonzero(x)
        rows.append((i, SparseVector(a.shape[1], at.tolist(), x[at].tolist()) if i % 3 else Vectors.dense(x.tolist()), "kept"))
    df = spark.createDataFrame(rows, ["i", "features", "row"]).repartition(4)
    m = svd.fit_truncated_svd(df, "features", 4)
    assert m.components.shape == (4, 3000)
    values = np.linalg.svd(a, compute_uv=False)[:4]
    assert np.allclose(m.singular_values, values, rtol=1e-6)
    assert np.allclose(m.components @ m.components.T, np.eye(4), atol=1e-9)
    out = m.transform(df, "features", "svd").withColumn("svd", vector_to_array("svd")).collect()
    assert all(np.allclose(r.svd, m.components @ a[r.i], atol=1e-9) and r.row == "kept" for r in out)
    assert np.allclose(np.linalg.norm([r.svd for r in out], axis=0), values, rtol=1e-6)


def test_wide_and_narrow_agree(spark, monkeypatch):
    a = _matrix(120, 40, 7)
    df = spark.createDataFrame([(Vectors.dense(x.tolist()),) for x in a], ["features"])
    narrow = svd.fit_truncated_svd(df, "features", 3)
    monkeypatch.setattr(svd, "WIDE", 10)
    wide = svd.fit_truncated_svd(df, "features", 3)
    assert np.allclose(narrow.singular_values, wide.singular_values, rtol=1e-6)
    assert np.allclose(narrow.components, wide.components, atol=1e-4)
    with pytest.raises(ValueError):
        svd.fit_truncated_svd(df, "features", 41)


def test_wide_passes_send_products_not_columns_to_the_driver(spark, monkeypatch):
    a = _matrix()
    rows = [(SparseVector(a.shape[1], np.flatnonzero(x).tolist(), x[np.flatnonzero(x)].tolist()),) for x in a]
    df = spark.createDataFrame(rows, ["features"]).repartition(3)
    monkeypatch.setattr(svd, "BLOCK_ENTRIES", 5000)           # several blocks a task
    from pyspark.sql.classic.dataframe import DataFrame
    seen = []
    whole = DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: (lambda t: (seen.append(t.num_rows), t)[1])(whole(self)))
    m = svd.fit_truncated_svd(df, "features", 4)
    assert np.allclose(m.singular_values, np.linalg.svd(a, compute_uv=False)[:4], rtol=1e-6)
    assert len(seen) == 1                                     # the model's components; before, a table of columns a pass


def test_wide_without_enough_directions(spark):
    for n in (0, 2):
        rows = [(SparseVector(3000, [i, 2500], [1.0, 2.0]),) for i in range(n)] + [(SparseVector(3000, [], []),)] * 3
        df = spark.createDataFrame(rows, ["features"])
        m = svd.fit_truncated_svd(df, "features", 3)
        a = np.asarray([r[0].toArray() for r in rows])
        assert np.allclose(m.singular_values, np.linalg.svd(a, compute_uv=False)[:3], atol=1e-7)
        assert np.allclose(m.components @ m.components.T, np.eye(3), atol=1e-9)
