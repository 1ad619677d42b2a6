"""Exact integer k-means over Hilbert-ordered blocks with min/max boxes.

Vectors become whole numbers floor(256 * x). They are ordered along a Hilbert curve over the
``AXES`` components of largest variance (``BITS`` bits each), dealt to tasks by ranges of it and
packed into blocks of ``BLOCK`` vectors with a box: the least and greatest value of every
component. The blocks are written once; each round is one pass over them.

A box decides which centroids can be nearest to any of its vectors:

* a centroid whose least distance to the box exceeds the greatest distance of another is out;
* of those left, one is compared with the centroid nearest to the box's middle. The difference of
  two squared distances is linear in the vector, so its least value over the box is exact; a
  positive one rules the centroid out.

The candidates are compared with every vector of the block in one matrix product (doubles while
products stay below 2^53, else 64-bit integers), ties going to the smaller number. Tasks
return a sum and a count per centroid, so a round moves k rows a task, whatever the data.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinity are left
out; rows that repeat an id or a vector are vectors of their own (copies are spread over tasks by row
number); a null id is hashed as ``2:``; with fewer vectors than centroids every vector is one; an
empty table gives no rows; extra columns are ignored. A component beyond 2^27 after
scaling is refused with ValueError, since squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
AXES, BITS = 16, 4
BLOCK = 128
LARGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (n x axes, whole numbers below 2^bits) on the Hilbert curve
    (Skilling's transform, all rows at once); axes x bits is at most 64."""
    x = cells.T.astype(np.int64)
    axes, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[axes - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << np.uint64(1)) | ((x[i] >> bit) & 1).astype(np.uint64)
    return key


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector between lo and hi, ascending."""
    below, above = centroids - lo, hi - centroids
    least = (np.maximum(0, np.maximum(-below, -above)) ** 2).sum(1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    left = np.flatnonzero(least <= most.min())
    c = centroids[left]
    pivot = c[((2 * c - lo - hi).astype(np.float64) ** 2).sum(1).argmin()]
    gap = c - pivot                                  # d(x, c) - d(x, pivot) = |c|^2 - |pivot|^2 - 2 x gap
    best = (c * c - pivot * pivot).sum(1) - 2 * np.maximum(lo * gap, hi * gap).sum(1)
    return left[best <= 0]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (the first of equals) and its squared distance, exactly."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * vectors.shape[1] * largest * largest < 1 << 53:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        d = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
    else:
        d = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best].astype(np.int64)


def _with_key(axes: list[int], low: np.ndarray, high: np.ndarray, dimensions: int):
    width = np.maximum(high - low, 1).astype(np.float64)

    def run(batches):
        for b in batches:
            v = b.column(2).flatten().to_numpy().reshape(-1, dimensions)[:, axes]
            cell = np.minimum(((v - low) / width * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            key = (hilbert_keys(cell, BITS) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], [*b.schema.names, "place"])

    return run


def _pack(dimensions: int):
    """Consecutive vectors of a task into blocks."""
    def block(ids: list, vectors: list) -> pa.RecordBatch:
        v = np.concatenate(vectors)
        ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.astype(np.int32).tobytes()], pa.binary())
                                                                                   for x in (v, v.min(0), v.max(0)))],
            ["ids", "vectors", "lo", "hi"])

    def run(batches):
        ids, vectors, held = [], [], 0
        for b in batches:
            at, v = 0, b.column(1).flatten().to_numpy().reshape(-1, dimensions)
            while at < b.num_rows:
                n = min(BLOCK - held, b.num_rows - at)
                ids.append(b.column(0).slice(at, n))
                vectors.append(v[at:at + n])
                at, held = at + n, held + n
                if held == BLOCK:
                    yield block(ids, vectors)
                    ids, vectors, held = [], [], 0
        if held:
            yield block(ids, vectors)

    return run


def _assigned(batches, centroids: np.ndarray, dimensions: int):
    """(ids, vectors, cluster, distance) of every block."""
    for b in batches:
        for i in range(b.num_rows):
            v, lo, hi = (np.frombuffer(b.column(k)[i].as_py(), np.int32).astype(np.int64).reshape(-1, dimensions) for k in (1, 2, 3))
            left = candidates(lo[0], hi[0], centroids)
            best, d = nearest(v, centroids[left])
            yield b.column(0)[i].values, v, left[best], d


def _sums(centroids, dimensions: int):
    def run(batches):
        c = np.asarray(centroids.value, np.int64).reshape(-1, dimensions)
        total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
        for _, v, cluster, _ in _assigned(batches, c, dimensions):
            np.add.at(total, cluster, v)
            count += np.bincount(cluster, minlength=len(c))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
                                         ["cluster", "count", "total"])

    return run


def _rows(centroids, dimensions: int):
    def run(batches):
        c = np.asarray(centroids.value, np.int64).reshape(-1, dimensions)
        for ids, _, cluster, d in _assigned(batches, c, dimensions):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def scaled(vectors: Column, dimensions: int) -> tuple[Column, Column]:
    """Whether a vector is kept, and its whole numbers."""
    sound = (F.size(vectors) == dimensions) & F.forall(
        vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound, F.lit(False)), F.transform(vectors, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def blocks(points: DataFrame, dimensions: int, spread) -> DataFrame:
    """The written zone-mapped blocks of ``points`` (row, vec_id, v); ``spread`` holds the least value,
    greatest value and variance of every component."""
    axes = sorted(sorted(range(dimensions), key=lambda i: (-(spread[f"s{i}"] or 0), i))[:AXES])
    low, high = (np.asarray([spread[f"{k}{i}"] for i in axes], np.int64) for k in "ab")
    kind = points.schema["vec_id"].dataType.simpleString()
    keyed = points.mapInArrow(_with_key(axes, low, high, dimensions), f"row long, vec_id {kind}, v array<long>, place long")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.xxhash64("row")                           # copies of a vector share their place
    ordered = keyed.withColumn("salt", salt).repartitionByRange(parts, "place", "salt").sortWithinPartitions("place", "salt")
    return materialize(ordered.select("vec_id", "v").mapInArrow(
        _pack(dimensions), f"ids array<{kind}>, vectors binary, lo binary, hi binary"), "zone-blocks")


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
            centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept row."""
    spark = vectors.sparkSession
    kept, whole = scaled(F.col(vector_col), dimensions)
    points = materialize(vectors.filter(kept).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"),
                                                     whole.alias("v")), "zone-points")
    spread = points.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("top"), *(
        f(F.col("v")[i]).alias(f"{k}{i}") for i in range(dimensions) for k, f in (("a", F.min), ("b", F.max), ("s", F.var_pop)))).first()
    kind = points.schema["vec_id"].dataType.simpleString()
    if spread["top"] is None:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if spread["top"] > LARGEST:
        raise ValueError(f"a component of {spread['top']} / {SCALE}: squared distances would not fit a long")
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = points.select(name.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()      # at most ``centroids`` rows
    now = [list(r.v) for r in seeds]
    zones = blocks(points, dimensions, spread)
    for _ in range(rounds):
        sums = zones.mapInArrow(_sums(spark.sparkContext.broadcast(now), dimensions), "cluster int, count long, total array<long>")
        new = sums.select("cluster", "count", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(
            F.sum("x").alias("x"), F.sum("count").alias("n")).collect()                            # centroids x dimensions rows
        for r in new:
            now[r.cluster][r.i] = r.x // r.n
    rows = materialize(zones.mapInArrow(_rows(spark.sparkContext.broadcast(now), dimensions),
                                        f"vec_id {kind}, cluster int, distance long"), "zone-rows")
    inertia = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = spark.createDataFrame([(i, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, now[i])).encode()).hexdigest())
                                   for i, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(              # a row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(dimensions: int, centroids: int, rounds: int) -> str:
    near = """a{r} AS MATERIALIZED (SELECT * FROM (
        SELECT d.*, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS o FROM (
            SELECT p.rid, c.k AS cluster, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance
            FROM p JOIN c{r} c ON p.i = c.i GROUP BY p.rid, c.k) d) WHERE o = 1)"""
    move = """c{n} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
        FROM a{r} JOIN p USING (rid) GROUP BY cluster, i) m ON m.cluster = c.k AND m.i = c.i)"""
    steps = [s.format(r=r, n=r + 1) for r in range(rounds) for s in (near, move)]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, v, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS rid
    FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {dimensions})),
p AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(1, {dimensions + 1})) AS i FROM kept),
c0 AS MATERIALIZED (SELECT rid AS k, i, x FROM p WHERE rid < {centroids}),
{", ".join(steps)},
{near.format(r=rounds)},
s AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN s ON s.k = cluster"""


SQL = _sql(DIMENSIONS, CENTROIDS, ROUNDS)
