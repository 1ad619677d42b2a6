"""Exact quantiles of many series at once, without a value map in one task.

A series is a numeric expression over the rows (nulls do not count); all series of a call share the
passes, so a column per fold is as many series as there are folds.

1. One aggregate counts every series and brackets each wanted rank between two approximate quantiles
   (``percentile_approx``: a sketch of bounded size per series and task).
2. One aggregate counts what lies below and inside each bracket. A bracket that misses its rank is
   opened on both sides, so the result never depends on the sketch.
3. Values inside the brackets, a few thousandths of the rows, are counted per distinct value
   (partial counts in the tasks, so a value that half the rows share moves as one row a task), dealt by
   ranges of (bracket, value) and written once. Totals per range, at most ranges + brackets rows, become
   offsets; only the ranges that hold a wanted rank are summed value by value.

Ranks follow linear interpolation: position p (n - 1) among n values, as ``percentile`` does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

ACCURACY = 10_000            # of the sketch; a bracket spans about 6 / ACCURACY of a series


def _between(x: Column, low: float | None, high: float | None) -> Column:
    inside = x.isNotNull()
    if low is not None:
        inside = inside & (x >= F.lit(low))
    return inside if high is None else inside & (x <= F.lit(high))


def _below(x: Column, low: float | None) -> Column:
    return F.lit(False) if low is None else x < F.lit(low)


def exact_quantiles(df: DataFrame, series: dict[str, Column], probs: list[float], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """The quantiles ``probs`` of every series (None for a series without values): driver scalars, as
    many as series x probs."""
    if not series or not probs:
        return {name: [None] * len(probs) for name in series}
    names = list(series)
    xs = {name: series[name].cast("double") for name in names}
    margin = 3.0 / accuracy
    cuts = [min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)]
    first = df.agg(*[a for i, name in enumerate(names) for a in (
        F.count(xs[name]).alias(f"n{i}"), F.percentile_approx(xs[name], cuts, accuracy).alias(f"q{i}"))]).first()
    count = {name: first[f"n{i}"] for i, name in enumerate(names)}
    # a bracket: series, low, high; ranks are counted from 0
    wanted = [(name, j) for name in names if count[name] for j in range(len(probs))]
    place = {(name, j): probs[j] * (count[name] - 1) for name, j in wanted}
    bracket = {}
    for name, j in wanted:
        q = first[f"q{names.index(name)}"]
        bracket[name, j] = (q[2 * j] if cuts[2 * j] > 0 else None, q[2 * j + 1] if cuts[2 * j + 1] < 1 else None)
    if not wanted:
        return {name: [None] * len(probs) for name in names}
    while True:
        sums = df.agg(*[a for i, (name, j) in enumerate(wanted) for a in (
            F.count_if(_below(xs[name], bracket[name, j][0])).alias(f"b{i}"),
            F.count_if(_between(xs[name], *bracket[name, j])).alias(f"c{i}"))]).first()
        missed = [key for i, key in enumerate(wanted) if not (
            sums[f"b{i}"] <= math.floor(place[key]) and math.ceil(place[key]) < sums[f"b{i}"] + sums[f"c{i}"])]
        if not missed:
            break
        for key in missed:
            bracket[key] = (None, None)
    inside = F.filter(F.array(*[F.when(_between(xs[name], *bracket[name, j]), F.struct(F.lit(i).alias("t"), xs[name].alias("x")))
                                for i, (name, j) in enumerate(wanted)]), lambda v: v.isNotNull())
    picked = _select(df.select(F.explode(inside).alias("v")).select("v.t", "v.x"),
                     {i: (sums[f"b{i}"], {math.floor(place[key]), math.ceil(place[key])}) for i, key in enumerate(wanted)})
    out: dict[str, list[float | None]] = {name: [None] * len(probs) for name in names}
    for i, (name, j) in enumerate(wanted):
        at = place[name, j]
        low, high = picked[i, math.floor(at)], picked[i, math.ceil(at)]
        out[name][j] = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
    return out


def _select(values: DataFrame, ranks: dict[int, tuple[int, set[int]]]) -> dict[tuple[int, int], float]:
    """``values`` (t, x): the value of every wanted rank of t; ``ranks``: t -> (values below all of t's, ranks)."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "order-counts")
    counts = values.groupBy("t", "x").agg(F.count("*").alias("c")).repartitionByRange(parts, "t", "x")
    counts.withColumn("part", F.spark_partition_id()).write.parquet(path)
    counts = spark.read.schema("t int, x double, c long, part int").parquet(path)
    targets, before = [], {t: below for t, (below, _) in ranks.items()}
    # at most ranges + brackets rows
    for r in sorted(counts.groupBy("t", "part").agg(F.sum("c").alias("c")).collect(), key=lambda r: (r.t, r.part)):
        targets += [(r.t, r.part, rank, rank - before[r.t]) for rank in ranks[r.t][1] if before[r.t] <= rank < before[r.t] + r.c]
        before[r.t] += r.c
    wanted = spark.createDataFrame(targets, "t int, part int, rank long, inner long")        # two per bracket
    upto = F.sum("c").over(Window.partitionBy("t", "part", "rank").orderBy("x"))
    rows = counts.join(F.broadcast(wanted), ["t", "part"]).withColumn("upto", upto) \
        .filter((F.col("upto") > F.col("inner")) & (F.col("upto") - F.col("c") <= F.col("inner")))
    return {(r.t, r["rank"]): r.x for r in rows.select("t", "rank", "x").collect()}
