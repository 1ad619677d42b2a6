"""The corpus pipeline: documents through five stages, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. Rows that a stage repeats (mixing) stay rows
of their own in the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from tessera.llm.common import materialize, prepare, table, utf8


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled rows of ``docs``; rows with a score of 0.5 or more go."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(F.coalesce(toxicity.scorer(model)(utf8(F.col("text")))["score"], F.lit(0.0)) < 0.5)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    prepare(spark)
    return exact_dedup.drop_copies(docs).select(*docs.columns)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: one row of each component stays."""
    prepare(spark)
    return ngram_join.drop_near_copies(docs, shingle=5, percent=80).select(*docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing within the budget that holds every source whole: rows of small
    sources are read more than once, none is lost."""
    prepare(spark)
    # whole rows travel in a struct, so that no column of theirs meets one of mixing's
    mixed, _ = mixing.mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"))
    return mixing.realise(mixed).select("row.*")


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids and the measured round trip of every row."""
    prepare(spark)
    return pieces.encode_documents(docs, keep=("source",))


STAGES = [("toxicity", stage_toxicity), ("exact_dedup", stage_exact_dedup), ("near_dedup", stage_near_dedup),
          ("mixing", stage_mixing), ("sentencepiece", stage_sentencepiece)]

#: The learned, permuted and encoded stages are not SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
