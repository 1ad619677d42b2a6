"""The corpus pipeline on the smallest tables: every stage against its own input."""

import collections
import re

import corpus_pipeline
from tessera.llm.common import materialize, table
from tessera.llm import exact_dedup, ngram_join, pieces

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF), f"test-{name}")
        assert after.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        left = collections.Counter(r.doc_id for r in after.select("doc_id").collect())
        assert set(left) <= ids
        if name == "exact_dedup":
            key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert sum(left.values()) == len({key(r.text) for r in before.collect()})
            assert exact_dedup.dedup(after).filter("group_size > 1").count() == 0
        if name == "near_dedup":
            joined = ngram_join.join(before, shingle=5, percent=80)
            assert sum(left.values()) == joined.filter("n_shingles > 0").select("component_id").distinct().count() + joined.filter("n_shingles = 0").count()
        if name == "mixing":
            assert set(left) == ids
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    text = collections.Counter((r.doc_id, r.text) for r in before.collect())
    back = out.select("doc_id", pieces.decoder()("ids").alias("t"), "round_trip").collect()
    assert all(r.round_trip for r in back) and collections.Counter((r.doc_id, r.t) for r in back) == text


def test_pipeline_of_an_empty_table(spark, tmp_path):
    table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
