"""Global ranks and running sums without a one-partition window.

A global order is cut into buckets by a function that is monotone in the sort key
(a hex prefix of an md5), or rows are dealt by ranges of the key itself. Per-bucket totals are small
(bounded by the bucket count, which we choose), so their prefix sums are computed on
that small table and broadcast back; inside each bucket an ordinary partitioned
window finishes the job. Every bucket is a separate task, so no single task sees
the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.session import scratch_path

BUCKET = "_bucket"


def _with_bucket_offsets(df: DataFrame, value_cols: dict[str, Column]) -> DataFrame:
    """Attach, per row, the sum of ``value_cols`` over all *earlier* buckets.

    The bucket table has one row per non-empty bucket (at most MAX_BUCKETS per stratum).
    Its join is left to AQE: broadcast when its measured size is small, otherwise a
    shuffle join on the bucket -- the same partitioning the per-bucket window needs next,
    so the fallback adds no extra exchange of the big side."""
    totals = df.groupBy(BUCKET).agg(*[F.sum(v).alias(f"_tot_{k}") for k, v in value_cols.items()])
    w = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        BUCKET, *[F.coalesce(F.sum(f"_tot_{k}").over(w), F.lit(0)).alias(f"_off_{k}") for k in value_cols]
    )
    return df.join(offsets, BUCKET, "left")


def bucketed_running_sum(df: DataFrame, bucket: Column, order: list[Column],
                         values: dict[str, Column]) -> DataFrame:
    """Running (inclusive) sums of ``values`` in the global order ``(bucket, *order)``.

    ``bucket`` must be non-decreasing along ``order`` and have a bounded number of
    distinct values. Output columns are named after the keys of ``values``."""
    staged = df.withColumn(BUCKET, bucket)
    for k, v in values.items():
        staged = staged.withColumn(f"_v_{k}", v)
    staged = _with_bucket_offsets(staged, {k: F.col(f"_v_{k}") for k in values})
    w = Window.partitionBy(BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for k in values:
        staged = staged.withColumn(k, F.col(f"_off_{k}") + F.sum(f"_v_{k}").over(w))
    drop = [BUCKET] + [f"_v_{k}" for k in values] + [f"_off_{k}" for k in values]
    return staged.drop(*drop)


def md5_order_key(key_cols: list[str], seed: int) -> Column:
    """Deterministic shuffle key reproducible in any SQL engine: md5(seed || '|' || key...)."""
    parts = [F.lit(str(seed))] + [F.coalesce(col(c).cast("string"), F.lit("")) for c in key_cols]
    return F.md5(F.concat_ws("|", *parts))


MAX_HEX_DIGITS = 5          # at most 16^5 (about one million) md5 buckets per stratum


def hex_digits_for(n_rows: int, rows_per_bucket: int = 2_000_000) -> int:
    """Leading hex digits of an md5 so that buckets hold about ``rows_per_bucket`` rows
    (at least 256 buckets, at most 16^MAX_HEX_DIGITS; beyond that buckets grow and the
    per-bucket window sorts spill)."""
    need = max(1.0, n_rows / float(rows_per_bucket))
    return int(min(MAX_HEX_DIGITS, max(2, math.ceil(math.log(need, 16)))))


def _rank_core(keyed: DataFrame, strata: list[str], order: list[Column], value: Column, rank_col: str,
               hex_digits: int) -> DataFrame:
    """Running sum of ``value`` in the order (strata, _h, *order); buckets are
    (strata index, hex prefix of _h)."""
    prefix = F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("long")
    if strata:
        # strata are folded into the bucket through a dense index of the (small) set of
        # strata values, so the bucket stays a single orderable long
        sidx = (keyed.select(*[col(s) for s in strata]).distinct()
                .withColumn("_sidx", F.row_number().over(Window.orderBy(*[col(s) for s in strata])) - 1))
        keyed = keyed.join(sidx, strata, "left")
        bucket = F.col("_sidx") * F.lit(16 ** hex_digits) + prefix
    else:
        bucket = prefix
    out = bucketed_running_sum(keyed, bucket, [F.col("_h")] + order, {rank_col: value})
    return out.drop("_sidx")


def global_rank(df: DataFrame, key_cols: list[str], seed: int = 42,
                strata: list[str] | None = None, rank_col: str = "rank",
                hex_digits: int | None = None) -> DataFrame:
    """1-based rank of each row in the order (strata..., md5(seed|key), key...).

    The key columns must identify rows (the order is then total and reproducible
    by a SQL oracle). Buckets are (strata, md5 hex prefix). When keys may repeat, use
    ``global_rank_with_copies``."""
    strata = strata or []
    if hex_digits is None:
        hex_digits = hex_digits_for(df.count())
    keyed = df.withColumn("_h", md5_order_key(key_cols, seed))
    out = _rank_core(keyed, strata, [col(c) for c in key_cols], F.lit(1).cast("long"), rank_col, hex_digits)
    return out.drop("_h")


def global_rank_with_copies(df: DataFrame, key_cols: list[str], seed: int = 42,
                            strata: list[str] | None = None, rank_col: str = "rank") -> DataFrame:
    """Like ``global_rank`` when the key columns may repeat -- copies of one key may be
    a large share of the table.

    Rows collapse to distinct key groups with their copy count (map-side partial
    aggregation); the groups are ranked with the copy count as weight (each group is
    one row, so no bucket is hot); rows receive their group's start rank by an equi-join
    on a group id (AQE splits a hot key across tasks). Copies take consecutive ranks:
    the rows of a group are numbered per task partition by a window over
    (group, partition) -- no task holds a whole group -- plus the number of the group's
    rows in earlier partitions. Copies are interchangeable, so which copy gets which
    rank does not change any result."""
    strata = strata or []
    keyed = (df.withColumn("_h", md5_order_key(key_cols, seed))
             .withColumn("_gid", F.md5(F.to_json(F.struct(*[col(c) for c in strata + key_cols])))))
    groups = keyed.groupBy("_gid").agg(F.first("_h").alias("_h"),
                                       *[F.first(col(c)).alias(c) for c in strata],
                                       F.count(F.lit(1)).alias("_c"))
    n_groups = groups.count()
    cum = _rank_core(groups, strata, [F.col("_gid")], F.col("_c"), "_end", hex_digits_for(n_groups))
    cum = cum.select("_gid", "_c", (F.col("_end") - F.col("_c")).alias("_start"))
    # the partition a row is read in (taken before any shuffle: after the join a hot group
    # would sit in one partition, while here its copies are spread over the input)
    rows = keyed.drop("_h").withColumn("_pid", F.spark_partition_id()).join(cum, "_gid")
    many = rows.filter(F.col("_c") > 1)
    per_part = many.groupBy("_gid", "_pid").agg(F.count(F.lit(1)).alias("_pc"))
    earlier = Window.partitionBy("_gid").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_part.select("_gid", "_pid", F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_poff"))
    inside = Window.partitionBy("_gid", "_pid").orderBy(F.monotonically_increasing_id())
    numbered = (many.join(offs, ["_gid", "_pid"])
                .withColumn("_i", (F.col("_poff") + F.row_number().over(inside) - 1).cast("long"))
                .drop("_poff"))
    single = rows.filter(F.col("_c") == 1).withColumn("_i", F.lit(0).cast("long"))
    out = single.unionByName(numbered)
    return out.withColumn(rank_col, F.col("_start") + F.col("_i") + 1).drop("_gid", "_c", "_start", "_pid", "_i")


def range_running_sum(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Running (inclusive) sums of ``values`` in the order of the ``order`` columns.

    Rows are dealt by ranges of the whole order (a value that many rows share is split if later columns differ) and
    written once; a total per range, worked out for all of them in one aggregate, becomes the range's offset,
    and each range is summed on its own. Output columns are named after the keys of ``values``."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    staged = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    staged.repartitionByRange(parts, *[col(c) for c in order]).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    schema = staged.withColumn("_part", F.lit(0)).schema
    rows = spark.read.schema(schema).parquet(path)
    before, offsets = {k: 0 for k in values}, []
    for r in sorted(rows.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(k) for k in values]).collect(), key=lambda r: r["_part"]):   # a row per range
        offsets.append((r["_part"], *before.values()))
        before = {k: n + (r[k] or 0) for k, n in before.items()}
    kinds = {k: schema[f"_v_{k}"].dataType.simpleString() for k in values}
    total = {"int": "bigint", "float": "double"}
    table = spark.createDataFrame(offsets, "_part int, " + ", ".join(f"_off_{k} {total.get(t, t)}" for k, t in kinds.items()))
    w = Window.partitionBy("_part").orderBy(*[col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(table), "_part")
    return out.select(*[col(c) for c in df.columns], *[(F.col(f"_off_{k}") + F.sum(f"_v_{k}").over(w)).alias(k) for k in values])
