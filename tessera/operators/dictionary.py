"""Category numbers for columns with any number of categories.

A dictionary is a written table: distinct (column, value), dealt by ranges of it and numbered within each
range by position; a table of offsets with at most ranges + columns rows turns that into the
alphabetical number per column. No list of categories reaches the driver. Values meet their numbers by a join,
which is broadcast only where the column's values are known to be small, and feature vectors are put together in
tasks as sparse vectors, without the attribute names that Spark ML would keep for every category.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col
from tessera.session import broadcast_limit_bytes, scratch_path, ship

_SCHEMA = "name string, value string, slot long"


@dataclass
class Dictionary:
    """Numbers 0, 1, ... of every column's categories in alphabetical order (of their UTF-8 bytes)."""
    path: str                    # table (name, value, slot)
    sizes: dict[str, int]        # categories per column
    widths: dict[str, int]       # bytes of all categories per column

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_SCHEMA).parquet(self.path)

    def _small(self, rows: DataFrame, column: str) -> DataFrame:
        held = self.widths.get(column, 0) + 64 * self.sizes.get(column, 0)
        return F.broadcast(rows) if held <= broadcast_limit_bytes(rows.sparkSession) else rows

    def encode(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """``df`` with the number of the column's value as ``out`` (long); null for null and unknown values."""
        key = _free(df, "value")
        rows = self.rows(df.sparkSession).filter(F.col("name") == column).select(F.col("value").alias(key), F.col("slot").alias(out))
        return df.join(self._small(rows, column), col(column).cast("string") == F.col(key), "left").drop(key)

    def decode(self, df: DataFrame, index: str, column: str, out: str) -> DataFrame:
        """``df`` with the category of ``column`` that has the number in ``index`` as ``out``."""
        key = _free(df, "slot")
        rows = self.rows(df.sparkSession).filter(F.col("name") == column).select(F.col("slot").alias(key), F.col("value").alias(out))
        return df.join(self._small(rows, column), col(index).cast("long") == F.col(key), "left").drop(key)


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{i}" for i in range(len(taken) + 1)) if n not in taken)


def fit_dictionary(df: DataFrame, columns: list[str]) -> Dictionary:
    """Number the present values of ``columns`` (as text)."""
    spark = df.sparkSession
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("value")) for i, c in enumerate(columns)]))
                       .alias("v")).select("v.*").filter("value is not null").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "dictionary")
    # consecutive numbers within a range, in its order
    values.repartitionByRange(parts, "i", "value").sortWithinPartitions("i", "value") \
        .withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{path}/values")
    values = spark.read.schema("i int, value string, id long").parquet(f"{path}/values")
    part = F.shiftright("id", 33)
    offsets, sizes, widths = [], [0] * len(columns), [0] * len(columns)
    # at most ranges + columns rows
    for r in sorted(values.groupBy("i", part.alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("n"),
                                                                F.sum(F.octet_length("value")).alias("b")).collect(), key=lambda r: (r.i, r.part)):
        offsets.append((r.i, r.part, sizes[r.i] - r["first"]))
        sizes[r.i] += r.n
        widths[r.i] += r.b
    table = spark.createDataFrame(offsets, "i int, part long, shift long")
    names = F.element_at(F.lit(list(columns)).cast("array<string>"), F.col("i") + 1)
    values.withColumn("part", part).join(F.broadcast(table), ["i", "part"]).select(
        names.alias("name"), "value", (F.col("id") + F.col("shift")).alias("slot")).write.parquet(f"{path}/numbers")
    return Dictionary(f"{path}/numbers", dict(zip(columns, sizes)), dict(zip(columns, widths)))


def _vectors(numeric: int, sizes: list[int]):
    """Feature vectors from (row, numbers, slots): numbers first, then one place per category of each column."""
    width = numeric + sum(sizes)
    first = numeric + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.zeros(0, np.int64)
    dense = width <= 1.5 * (numeric + len(sizes) + 1)

    def run(batches):
        for b in batches:
            n = b.num_rows
            num = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, numeric) if numeric else np.zeros((n, 0))
            slot = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(sizes)) if sizes else np.zeros((n, 0))
            known = ~np.isnan(slot)
            at = np.concatenate([np.broadcast_to(np.arange(numeric), (n, numeric)), np.where(known, slot, 0).astype(np.int64) + first], 1)
            keep, value = np.concatenate([num != 0, known], 1), np.concatenate([num, known.astype(np.float64)], 1)
            if dense:
                whole = np.zeros((n, width))
                row, place = np.nonzero(keep)
                whole[row, at[row, place]] = value[keep]
                lists = np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
                parts = [pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())),
                         pa.ListArray.from_arrays(pa.array(lists), pa.array(whole.ravel()))]
            else:
                lists = pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32))
                parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)),
                         pa.ListArray.from_arrays(lists, pa.array(at[keep].astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(value[keep]))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])],
                                             ["row", "features"])

    return run


def assemble(df: DataFrame, numeric: list[str], categorical: list[str], dictionary: Dictionary | None, out: str = "features") -> DataFrame:
    """``df`` with the feature vector: the numeric columns (null as NaN), then a 1 in the place of each column's category;
    unknown categories and nulls have none."""
    spark = df.sparkSession
    ship(spark)
    slots, x = [], df
    for c in categorical:
        slots.append(_free(x, "slot"))
        x = dictionary.encode(x, c, slots[-1])
    kept = [c for c in df.columns if c != out]

    def numbers(columns: list[Column], kind: str) -> Column:
        return F.array(*columns).cast(f"array<{kind}>")

    packed = x.select(F.struct(*[col(c) for c in kept]).alias("row"), numbers([col(c).cast("double") for c in numeric], "double").alias("num"),
                      numbers([F.col(s) for s in slots], "bigint").alias("slot"))
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("features", VectorUDT())])
    rows = packed.mapInArrow(_vectors(len(numeric), [dictionary.sizes[c] for c in categorical] if categorical else []), schema)
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], F.col("features").alias(out))
