"""The opN queries: thin applications of this folder's operators to whole tables, with SQL
where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (chat_format, exact_dedup, fim, fm_index, mixing, ngram_join, pieces, pii, ppm, quality_lines, toxicity, warc,
                         zone_clusters)
from tessera.llm.common import prepare, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql.strip()
        return fn
    return wrap


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_query("op2_warc")
def op2(spark, sf_dir):
    path = warc.archive_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "digest_ok")


@_query("op3_quality_lines")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_lines.judge(docs, quality_lines.fit(docs, table(spark, sf_dir, "labels")))


@_query("op4_mixing")
def op4(spark, sf_dir):
    """One row per reading of a document, with its place in the source's permutation."""
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.realise(mixed).select("doc_id", "source", "mix_epoch", "mix_block",
                                         F.col("mix_order.block").alias("block_order"), F.col("mix_order.row").alias("row_order"))


@_query("op5_ppm")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = ppm.fit(docs, ~ppm.held_out(F.col("doc_id")), order=ppm.ORDER)
    return ppm.score_documents(docs, model).withColumn("held_out", ppm.held_out(F.col("doc_id")))


@_query("op6_sentencepiece")
def op6(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


@_query("op7_pii")
def op7(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


@_query("op8_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
     g AS (SELECT *, count(*) OVER (PARTITION BY h) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""")
def op8(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@_query("op9_chat_format")
def op9(spark, sf_dir):
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chat = chat_format.format_records(chat_format.as_records(rows))
    return chat.select("conv_id", chat_format.read_back(F.col("chat.formatted"), F.col("chat.mask")).alias("r"), "chat.layout") \
        .select("conv_id", "r.*", "layout")


@_query("op10_ngram_join")
def op10(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


@_query("op11_fill_in_middle", fim.SQL)
def op11(spark, sf_dir):
    rows = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


@_query("op12_decontamination", fm_index.SQL)
def op12(spark, sf_dir):
    return fm_index.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@_query("op13_zone_clusters", zone_clusters.SQL)
def op13(spark, sf_dir):
    return zone_clusters.cluster(table(spark, sf_dir, "embeddings"))
