"""Truncated SVD of the (uncentred) feature matrix.

The right singular vectors of A are the eigenvectors of the Gram matrix A^T A, which
is assembled from JVM-side distributed statistics (Pearson correlation, variances,
means and count): A^T A = (n - 1) Cov + n mu mu^T. The Gram matrix is features x
features whatever the row count; its eigen-decomposition runs on the driver and the
projection is a JVM-side dot product per component.

Beyond ``WIDE`` columns no such matrix is made. A basis W of k + ``EXTRA`` columns is improved by
passes over the rows. W is a table, a row per column that holds anything; the entries that are not 0 are
written once in blocks, dealt by the last column that a row touches. In a pass each block meets the rows of W it asks for,
adds up its part of Z = A^T (A W), and Spark sums the parts by column. The driver sees the products W^T W, W^T Z and Z^T Z
only, (k + EXTRA) squared numbers each: they give the Ritz values (the squared singular values) and the matrix that turns Z into
the next W. Passes end when the first k values change by less than ``TOLERANCE`` or after ``PASSES``; then the
k components, which the model holds, are gathered once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.boost import BLOCK_ENTRIES, _entries, _raw
from tessera.session import scratch_path, ship

WIDE = 2048
EXTRA, PASSES, TOLERANCE = 10, 30, 1e-8
START = 1 << 14
SAME = 1e-12              # directions of Z that differ by less (squared, of 1) count as one


@dataclass
class SVDModel:
    components: np.ndarray        # k x p, rows are right singular vectors
    singular_values: np.ndarray   # k

    def project_array(self, arr: Column) -> Column:
        comps = []
        for row in self.components:
            v = F.lit([float(x) for x in row]).cast("array<double>")
            comps.append(F.aggregate(F.zip_with(arr, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        return F.array(*comps)

    def transform(self, df: DataFrame, input_col: str = "features", output_col: str = "features") -> DataFrame:
        if self.components.shape[1] > WIDE:
            return self._transform_wide(df, input_col, output_col)
        projected = self.project_array(vector_to_array(F.col(input_col)))
        return df.withColumn(output_col, array_to_vector(projected))

    def _transform_wide(self, df: DataFrame, input_col: str, output_col: str) -> DataFrame:
        """The same projection over the entries that are not 0."""
        spark = df.sparkSession
        ship(spark)
        held = spark.sparkContext.broadcast(np.ascontiguousarray(self.components.T))         # columns x k
        kept = [c for c in df.columns if c != output_col]

        def run(batches):
            v = held.value
            k = v.shape[1]
            for b in batches:
                n = b.num_rows
                row, f, x = _entries(b.column(1), b.column(2))
                out = np.stack([np.bincount(row, x * v[f, j], n) for j in range(k)], 1)
                ends = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
                parts = [pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())),
                         pa.ListArray.from_arrays(ends, pa.array(out.ravel()))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], ["row", "out"])

        at, values = _raw(F.col(input_col))
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), at, values)
        schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("out", VectorUDT())])
        return packed.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in kept], F.col("out").alias(output_col))


_BLOCK = ["block", "n", "row", "place", "v", "used"]


def _blocks(batches):
    """Rows as blocks of at most about BLOCK_ENTRIES entries: per block its rows' number, the entries that are not 0
    (row, place of the column in ``used``, value) and the columns it touches."""
    task, made, held, rows, entries = TaskContext.get().partitionId() << 33, 0, [], 0, 0

    def block() -> pa.RecordBatch:
        row, f, x = (np.concatenate(c) for c in zip(*held))
        used, place = np.unique(f, return_inverse=True)
        parts = (pa.array([c.tobytes()], pa.binary()) for c in (row.astype(np.int32), place.astype(np.int32), x))
        return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([rows], pa.int32()), *parts,
                                           pa.array([used.astype(np.int32)], pa.list_(pa.int32()))], _BLOCK)

    for b in batches:
        ends = b.column(1).offsets.to_numpy().astype(np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_ENTRIES, "right")) - 1))
            part = b.slice(lo, hi - lo)
            row, f, x = _entries(part.column(0), part.column(1))
            held.append((row + rows, f, x))
            rows, entries, lo = rows + hi - lo, entries + len(f), hi
            if entries >= BLOCK_ENTRIES:
                yield block()
                made, held, rows, entries = made + 1, [], 0, 0
    if entries:
        yield block()


def _lists(z: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))


def _matrix(column, width: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, width))] + [c.flatten().to_numpy().reshape(-1, width) for c in parts])


def _start(width: int):
    """Rows of the first basis: those of one stream of normal numbers, whatever the partitions. A task draws the stream up to its last
    column, START rows at a time."""
    def run(batches):
        f = np.sort(np.concatenate([np.zeros(0, np.int32)] + [b.column(0).to_numpy() for b in batches]))
        draw, at = np.random.default_rng(0), 0
        for lo in range(0, int(f[-1]) + 1 if len(f) else 0, START):
            rows = draw.standard_normal((START, width))
            upto = int(np.searchsorted(f, lo + START))
            if upto > at:
                yield pa.RecordBatch.from_arrays([pa.array(f[at:upto]), _lists(rows[f[at:upto] - lo])], ["f", "w"])
            at = upto

    return run


def _turned(turn: np.ndarray):
    """(f, row of a matrix) -> (f, that row times ``turn``)."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(_matrix(b.column(1), turn.shape[0]) @ turn)], ["f", "w"])

    return run


def _products(width: int):
    """A block's part of A^T (A W), by column."""
    def run(blocks: pa.Table, basis: pa.Table) -> pa.Table:
        used = basis.column("f").to_numpy()
        order = np.argsort(used)
        used, w = used[order], _matrix(basis.column("w"), width)[order]
        w, z = np.ascontiguousarray(w.T), np.zeros((width, len(used)))
        for i in range(blocks.num_rows):
            row, place = (np.frombuffer(blocks.column(c)[i].as_py(), np.int32) for c in ("row", "place"))
            x, n = np.frombuffer(blocks.column("v")[i].as_py(), np.float64), blocks.column("n")[i].as_py()
            for j in range(width):
                z[j] += np.bincount(place, x * np.bincount(row, x * w[j][place], n)[row], len(used))
        return pa.table({"f": pa.array(used.astype(np.int32)), "z": _lists(np.ascontiguousarray(z.T))})

    return run


def _moments(pairs: DataFrame, width: int) -> np.ndarray:
    """W^T W, W^T Z and Z^T Z of rows (w, z)."""
    def run(batches):
        out = np.zeros((3, width, width))
        for b in batches:
            w, z = (_matrix(b.column(i), width) for i in range(2))
            out += np.stack([w.T @ w, w.T @ z, z.T @ z])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["i", "x"])

    out = np.zeros(3 * width * width)
    for r in pairs.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():      # 3 x width x width
        out[r.i] = r.x
    return out.reshape(3, width, width)


def _square(products: np.ndarray) -> np.ndarray:
    """What makes columns with these products orthonormal; those that add nothing are left out."""
    lengths, axes = np.linalg.eigh(products)
    kept = lengths > SAME * lengths.max()
    return axes[:, kept] / np.sqrt(lengths[kept])


def _fit_wide(df: DataFrame, input_col: str, k: int, p: int) -> SVDModel:
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "svd-blocks")
    # rows of one range touch few of the rarer columns, so that few rows of W meet many blocks; ids deal out rows that agree
    df.select(*_raw(F.col(input_col))).repartitionByRange(parts, F.array_max("at"), F.monotonically_increasing_id()).mapInArrow(
        _blocks, "block long, n int, row binary, place binary, v binary, used array<int>").write.parquet(path)
    blocks = spark.read.schema("block long, n int, row binary, place binary, v binary").parquet(path)
    asks = spark.read.schema("block long, used array<int>").parquet(path).select(F.col("block").alias("asker"), F.explode("used").alias("f"))
    width = min(p, k + EXTRA)
    basis = asks.select("f").distinct().repartitionByRange(parts, "f").mapInArrow(_start(width), "f int, w array<double>")
    before, vals, turn, last = None, np.zeros(0), np.zeros((width, 0)), basis
    for _ in range(PASSES):
        found = blocks.groupBy("block").cogroup(asks.join(basis.hint("merge"), "f").groupBy("asker")).applyInArrow(
            _products(width), "f int, z array<double>")
        path = scratch_path(spark, "svd-pass")
        found.groupBy("f").agg(F.array(*[F.sum(F.col("z")[j]) for j in range(width)]).alias("z")).write.parquet(path)
        z = spark.read.schema("f int, z array<double>").parquet(path)
        ww, wz, zz = _moments(basis.join(z.hint("merge"), "f").select("w", "z"), width)
        if not ww.any():                                                       # no entry but 0
            break
        square = _square(ww)                                                   # W square is orthonormal
        vals, turn = np.linalg.eigh(square.T @ ((wz + wz.T) / 2) @ square)
        order = np.argsort(vals)[::-1]
        vals, turn, last = vals[order], square @ turn[:, order], basis
        if before is not None and len(vals[:k]) == len(before) and np.abs(vals[:k] - before).max() <= TOLERANCE * max(vals[0], 1e-300):
            break
        before = vals[:k]
        # the next W spans Z; its columns are scaled to 1, then made orthonormal, without those that add nothing
        size = np.sqrt(np.maximum(np.diag(turn.T @ zz @ turn), 0.0))
        scaled = turn[:, size > SAME * size.max()] / size[size > SAME * size.max()]
        step = scaled @ _square(scaled.T @ zz @ scaled)
        width = step.shape[1]
        basis = z.mapInArrow(_turned(step), "f int, w array<double>")
    return _gathered(last, turn[:, :k], np.maximum(vals[:k], 0.0), k, p)


def _gathered(basis: DataFrame, turn: np.ndarray, vals: np.ndarray, k: int, p: int) -> SVDModel:
    """The model: its k x columns numbers are gathered once. Without k directions that hold anything, the others
    are any that are orthogonal to them."""
    comps = np.zeros((p, turn.shape[1]))
    if turn.shape[1]:
        rows = basis.mapInArrow(_turned(turn), "f int, w array<double>").toArrow()
        comps[rows.column("f").to_numpy()] = _matrix(rows.column("w"), turn.shape[1])
    if comps.shape[1] < k:
        more = np.random.default_rng(0).standard_normal((p, k - comps.shape[1]))
        more -= comps @ (comps.T @ more)
        comps = np.concatenate([comps, np.linalg.qr(more)[0]], 1)
    return SVDModel(_signed(comps.T.copy()), np.sqrt(np.concatenate([vals, np.zeros(k - len(vals))])))


def _signed(comps: np.ndarray) -> np.ndarray:
    """Deterministic sign: the largest-magnitude entry of each component is positive."""
    for i in range(comps.shape[0]):
        j = int(np.argmax(np.abs(comps[i])))
        if comps[i, j] < 0:
            comps[i] = -comps[i]
    return comps


def fit_truncated_svd(df: DataFrame, input_col: str, k: int) -> SVDModel:
    first = df.select(F.unwrap_udt(F.col(input_col)).alias("v")).select(F.coalesce("v.size", F.size("v.values")).alias("p")).first()
    if first is not None and first.p > WIDE:
        if k > first.p:
            raise ValueError(f"{k} components asked of {first.p} columns")
        return _fit_wide(df, input_col, k, first.p)
    stats = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(input_col)).alias("s")).first()["s"]
    mu = np.asarray(stats["mean"].toArray())
    var = np.asarray(stats["variance"].toArray())
    n = float(stats["count"])
    p = mu.shape[0]
    if k > p:
        raise ValueError(f"{k} components asked of {p} columns")
    if n > 1 and p > 1:
        corr = np.asarray(Correlation.corr(df.select(input_col), input_col).first()[0].toArray())
        corr = np.nan_to_num(corr, nan=0.0)
        sd = np.sqrt(np.maximum(var, 0.0))
        cov = corr * np.outer(sd, sd)
        np.fill_diagonal(cov, var)
    else:
        cov = np.diag(var) if n > 1 else np.zeros((p, p))
    gram = (n - 1.0) * cov + n * np.outer(mu, mu)
    vals, vecs = np.linalg.eigh(gram)
    order = np.argsort(vals)[::-1][:k]
    return SVDModel(_signed(vecs[:, order].T), np.sqrt(np.maximum(vals[order], 0.0)))
