"""Exact duplicates with a heavy-hitter split, in DataFrame operations only.

Texts are equal when identical after deleting the white space ``[\\x20\\x09-\\x0D]``; the key is the
SHA-256 of what is left. A Misra-Gries pass (``freqItems``) names every digest that may
hold more than ``SUPPORT`` of the rows, at most 1 / SUPPORT of them; their true counts and
winners are worked out by an aggregate that combines within tasks (this drops false
candidates), and the verified winners, again at most 1 / SUPPORT rows, are broadcast:
rows of a frequent digest learn their group without moving. All other digests go through
an ordinary shuffle, where no group exceeds SUPPORT of the rows.

The row that stays has the most code points in its original text, then the smallest id.
Defined results: null counts as empty; null ids come after all ids; among rows that repeat
id and length one stays (``kept`` is true for exactly one row of a group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_REGEX, materialize

SUPPORT = 0.001


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, digest, n_chars of every row, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
                       F.unhex(F.sha2(F.regexp_replace(text, SPACE_REGEX, "").cast("binary"), 256)).alias("digest"),
                       F.length(text).alias("n_chars"))


def groups(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``rows`` (uid, doc_id, digest, n_chars; materialised) with keep_id, keep_uid and
    group_size, one row per row."""
    spark = rows.sparkSession
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id", "uid"))
    total = rows.count()
    named = rows.select(F.hex("digest").alias("h")).stat.freqItems(["h"], support).first()
    named = (named[0] or []) if named else []                # at most 1 / support digests
    candidates = spark.createDataFrame([(h,) for h in named], "h string").select(F.unhex("h").alias("digest"))
    winners = (rows.join(F.broadcast(candidates), "digest").groupBy("digest")
               .agg(F.count("*").alias("group_size"), best.alias("w")).filter(F.col("group_size") > F.lit(support * total))
               .select("digest", "group_size", F.col("w.doc_id").alias("keep_id"), F.col("w.uid").alias("keep_uid")))
    winners = materialize(winners, "dedup-winners")          # fewer than 1 / support rows
    heavy = rows.join(F.broadcast(winners), "digest")
    one = Window.partitionBy("digest")
    light = (rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
             .withColumn("group_size", F.count("*").over(one)).withColumn("w", best.over(one))
             .withColumns({"keep_id": F.col("w.doc_id"), "keep_uid": F.col("w.uid")}).drop("w"))
    return heavy.unionByName(light)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    rows = materialize(digests(docs, id_col, text_col), "dedup-digests")
    return groups(rows, support).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                                        (F.col("uid") == F.col("keep_uid")).alias("kept"),
                                        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each group, all columns kept. The rows are written once with
    a number, so the decision meets its row whatever repeats among the ids."""
    taken = {c.lower() for c in docs.columns}
    uid = next(n for n in (f"row_{i}" for i in range(len(taken) + 1)) if n not in taken)
    numbered = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "dedup-rows")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(numbered.select(
        F.col(uid).alias("uid"), F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE_REGEX, "").cast("binary"), 256)).alias("digest")), "dedup-digests")
    lost = groups(rows, support).filter(F.col("uid") != F.col("keep_uid")).select(F.col("uid").alias(uid))
    return numbered.join(lost, uid, "left_anti").drop(uid)
