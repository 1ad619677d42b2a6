"""Connected components of an edge table by alternating large-star and small-star steps.
Edges stay in Spark; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, comp) for every node that has an edge to another; comp is the least node
    reachable. Null ends are ignored. Raises if ``rounds`` do not suffice (they double the
    reach, so 60 do for any graph that fits on a cluster)."""
    e = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialize(large.distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v"))
        e = materialize(small.distinct(), "cc")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (now.n, now.h):
            return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(
                e.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node")))
        before = (now.n, now.h)
    raise RuntimeError("components did not settle")
