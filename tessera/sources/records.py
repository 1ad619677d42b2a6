"""JSON record sources and sinks.

A scoring request body carries its records under ``data`` or, for older clients,
``records`` -- exactly one of them, non-empty. Bodies are rows of a table (one JSON
document per line), so any number of requests is parsed in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def records_from_bodies(bodies: DataFrame, body_col: str, record_schema: T.StructType,
                        id_col: str | None = None) -> DataFrame:
    """Explode request bodies into records. A body with both keys, neither key, or an
    empty list fails the job with a validation message."""
    arr = T.ArrayType(record_schema)
    body = F.from_json(F.col(body_col), T.StructType([T.StructField("data", arr), T.StructField("records", arr)]))
    parsed = bodies.select(*([F.col(id_col)] if id_col else []), body.alias("_b"))
    has_data, has_rec = F.col("_b.data").isNotNull(), F.col("_b.records").isNotNull()
    chosen = (F.when(has_data & has_rec, F.raise_error(F.lit("use exactly one of 'data' or 'records'")))
              .when(has_data, F.col("_b.data")).when(has_rec, F.col("_b.records"))
              .otherwise(F.raise_error(F.lit("request has no 'data' records"))))
    checked = F.when(F.size(chosen) == 0, F.raise_error(F.lit("request records must not be empty"))).otherwise(chosen)
    return parsed.select(*([F.col(id_col)] if id_col else []), F.explode(checked).alias("_r")).select(
        *([F.col(id_col)] if id_col else []), "_r.*")


def write_records(df: DataFrame, path: str) -> str:
    """JSON Lines, one object per row; missing values written as null (not dropped)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def read_records(spark, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)
