"""Dataset store and append-only metadata tables.

Datasets are Parquet partitioned by ``dataset_id`` so a re-scan by id prunes to one
folder. History, manifests, job records and trained-model records are append-only
tables; listings are reads plus an explicit ordering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import source_name
from tessera.session import sql_conf


def file_stem(c) -> F.Column:
    """Last path segment without its final extension ('a/b.v1.csv' -> 'b.v1')."""
    last = source_name(c, default="")
    return F.regexp_replace(last, r"(.)\.[^.]*$", "$1")


def store_datasets(df: DataFrame, root: str, dataset_id: F.Column) -> str:
    """Write rows under root/dataset_id=<id>/ (one folder per dataset)."""
    df.withColumn("dataset_id", dataset_id).write.mode("overwrite").partitionBy("dataset_id").parquet(root)
    return root


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """All stored datasets; ids stay text ('007' is not 7)."""
    with sql_conf(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
        return spark.read.parquet(root)


def scan_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Partition-pruned read of one stored dataset."""
    return _stored(spark, root).filter(F.col("dataset_id") == dataset_id).drop("dataset_id")


def dataset_metadata(spark: SparkSession, root: str, filenames: DataFrame) -> DataFrame:
    """S5 metadata: per dataset id the row count (read from the partition column only),
    the column count, and name = stem of the uploaded file name.
    ``filenames``: (dataset_id, original_filename, created_at)."""
    stored = _stored(spark, root)
    n_cols = len(stored.columns) - 1
    counts = stored.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("row_count"))
    return (filenames.join(counts, "dataset_id", "inner")
            .select("dataset_id", file_stem(F.col("original_filename")).alias("name"), "original_filename",
                    "row_count", F.lit(n_cols).alias("column_count"), "created_at"))


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only write (one call per batch of records)."""
    df.write.mode("append").format(fmt).save(path)


def newest_first(df: DataFrame, ts_col: str, tie: str) -> DataFrame:
    """Listing order, newest first (explicit; files carry no order)."""
    return df.orderBy(F.col(ts_col).desc(), F.col(tie).desc())


def _documents(spark: SparkSession, path: str, name: str | None) -> DataFrame:
    """JSON documents, one a file called ``name`` (indented or not; a file is small and read
    whole), or without a name JSON Lines files of any number of documents."""
    if name is None:
        return spark.read.json(path)
    return spark.read.option("multiLine", True).option("pathGlobFilter", name).json(path)


def scan_manifests(spark: SparkSession, root: str, name: str | None = "metadata.json") -> DataFrame:
    """Every manifest under root/<package>/, with the package folder name."""
    m = _documents(spark, root + "/*/", name)
    return m.withColumn("package_dir", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))


def scan_trained_models(spark: SparkSession, root: str, name: str | None = "record.json") -> DataFrame:
    """Trained-model records, newest first (one file under root/<id>/ each, or JSON Lines)."""
    return newest_first(_documents(spark, root + "/*/" if name else root, name), "completed_at", "id")


def scan_job_records(spark: SparkSession, root: str) -> DataFrame:
    """{job, request} records flattened to one row per job."""
    j = spark.read.json(root)
    return j.select("job.*", *[F.col(f"request.{c}").alias(f"request_{c}")
                               for c in j.schema["request"].dataType.fieldNames()])
