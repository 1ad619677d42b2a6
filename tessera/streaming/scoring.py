"""Structured Streaming entry points that reuse the batch operators.

``score_stream``: each micro-batch goes through the same validation, scoring and
metrics as a batch request (``foreachBatch``) and is a scoring run of its own, named by model and
batch: predictions in the run's folder, then one history row if there are any. Scoring is stateless, so
no watermark or state store is involved.

``job_state_stream``: the lifecycle fold (latest state per job, runs started) as a streaming aggregation
whose state lives in the state store. A trigger writes the jobs that changed, a folder per batch; reading
takes the latest row of each job, and ``compact_job_state`` folds the folders so far into a snapshot.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joblog as J
from tessera.operators.score import Manifest
from tessera.sources.runs import read_document, score_run, write_document


def score_stream(stream: DataFrame, manifest: Manifest, model, out_path: str, history_path: str,
                 checkpoint_location: str, source: str = "stream", available_now: bool = True):
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch has the id it had: its rows and its history row are replaced
        score_run(batch.withColumn("batch_id", F.lit(batch_id)), manifest, model, out_path, history_path,
                  f"{re.sub(r"[^A-Za-z0-9._-]", "_", manifest.id)}-{batch_id}", source=source, ground_truth="", allow_empty=True)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def job_state_stream(events: DataFrame, out_path: str, checkpoint_location: str, available_now: bool = True):
    """Write, per trigger, the jobs whose state changed; ``read_job_state`` folds them."""
    state = J.job_state(events)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch replaces its folder
        batch.write.mode("overwrite").parquet(f"{out_path}/changes/batch_id={batch_id}")

    w = (state.writeStream.outputMode("update").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_job_state(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest state of every job: the snapshot, if there is one, and all changes after it."""
    changes = spark.read.parquet(f"{out_path}/changes").withColumn("batch_id", F.col("batch_id").cast("long"))
    try:
        snapshot = read_document(spark, f"{out_path}/snapshot.json")
    except AnalysisException:                     # not compacted yet
        snapshot = None
    if snapshot is not None:
        old = spark.read.schema(changes.drop("batch_id").schema).parquet(f"{out_path}/{snapshot['folder']}")
        changes = changes.filter(F.col("batch_id") > snapshot["upto"]).unionByName(old.withColumn("batch_id", F.lit(snapshot["upto"]).cast("long")))
    fields = [c for c in changes.columns if c not in ("job_id", "batch_id")]
    latest = changes.groupBy("job_id").agg(F.max_by(F.struct(*fields), "batch_id").alias("s"))
    return latest.select("job_id", "s.*")


def compact_job_state(spark: SparkSession, out_path: str) -> None:
    """Fold the changes so far into a snapshot that later reads start from. The snapshot counts once its document
    is in place, so readers see the old or the new one; what it folds may be deleted then."""
    upto = spark.read.parquet(f"{out_path}/changes").agg(F.max("batch_id").cast("long")).first()[0]
    if upto is None:
        return
    folder = f"snapshot-{uuid.uuid4().hex[:12]}"
    read_job_state(spark, out_path).write.parquet(f"{out_path}/{folder}")
    write_document(spark, f"{out_path}/snapshot.json", {"upto": upto, "folder": folder})
