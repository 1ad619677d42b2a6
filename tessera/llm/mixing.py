"""Mixing sources to target weights by temperature.

With token shares s_i, a source's weight is s_i^a / sum_j s_j^a. The exponent ``a`` in
[0, 1] is found by bisection: the largest one (closest to the natural mix) whose
entropy reaches ``entropy_share`` of log(number of sources), raised as far as needed so
that no source is repeated more than ``max_epochs`` times within the budget. The budget
is in tokens; by default it is the smallest one that holds every source whole at least
once, so no document is lost and small sources repeat.

The weights are realised by block permutations: a source's documents are dealt by hash
into blocks of about ``block_tokens`` tokens, every epoch has its own order of the blocks
and of the documents in a block, and a source is read epoch after epoch until its budget
of tokens is spent. The exponent is solved over (tokens, number of sources with so many) rows, of which T
tokens give at most sqrt(2 T), and a source's quota is an expression of its tokens, met by a join. Whole epochs are a number per source; in the last, partial epoch
whole blocks are taken by a running sum over the small block table and only the block at
the edge is cut document by document. So documents are never sorted or moved as a whole.

Defined results: a null source is a source of its own (named by ``NO_SOURCE`` in the
plan); documents without words weigh 0 tokens and come along in whole epochs and in taken
blocks; a table without words keeps every row once; rows that repeat an id are separate
rows; ties in the permutation go by id. The document that crosses the budget is taken, so
a source overshoots by less than one document (rows equal in id and text are taken together). ``mix`` replaces
columns called mix_epochs, mix_block and mix_key, ``realise`` also mix_epoch and mix_order; to keep such columns pass
them inside a struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_REGEX, materialize

ENTROPY_SHARE = 0.97
MAX_EPOCHS = 2.0
BLOCK_TOKENS = 1 << 20
SEED = 11
NO_SOURCE = "\u0000none"
SMALL_SOURCES = 200_000      # tables of a row per source are broadcast up to so many rows


@dataclass(frozen=True)
class MixPlan:
    """A source of t tokens has the weight (t / top) ^ exponent / norm and budget times that in tokens."""
    exponent: float
    budget: float
    top: float = 1.0
    norm: float = 1.0
    rows: tuple[tuple[str, int, float, float], ...] = ()     # source, tokens, weight, token budget; for a report, left out beyond SMALL_SOURCES


def _weights(tokens: np.ndarray, counts: np.ndarray, a: float) -> np.ndarray:
    w = (tokens / tokens.max()) ** a
    return w / (w * counts).sum()


def _entropy(w, counts=None) -> float:
    w = np.asarray(w, np.float64)
    n = np.ones(len(w)) if counts is None else counts
    some = w > 0
    return float(-(n[some] * w[some] * np.log(w[some])).sum())


def _bisect(ok, steps: int = 60) -> float:
    """Largest a in [0, 1] with ok(a); ok holds below some point. 0 if it never holds."""
    if ok(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def _bisect_up(ok, low: float, steps: int = 60) -> float:
    """Smallest a in [low, 1] with ok(a); ok holds above some point and at 1."""
    if ok(low):
        return low
    high = 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


def solve_counts(tokens: np.ndarray, counts: np.ndarray, *, entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS,
                 budget: float | None = None) -> MixPlan:
    """Exponent and budget when ``counts[i]`` sources have ``tokens[i]`` tokens each (all above 0)."""
    n, m = np.asarray(tokens, np.float64), np.asarray(counts, np.float64)
    if not len(n):
        return MixPlan(1.0, 0.0)

    def spend(w: np.ndarray) -> float:
        return float(budget) if budget is not None else float((n / w).max())

    def repeats(a: float) -> float:
        w = _weights(n, m, a)
        return float((spend(w) * w / n).max())

    target = entropy_share * math.log(m.sum())
    a = _bisect(lambda x: _entropy(_weights(n, m, x), m) >= target)
    # at a = 1 every source is repeated budget / all tokens times; a limit below that cannot be met
    if repeats(1.0) <= max_epochs * (1 + 1e-12):
        a = _bisect_up(lambda x: repeats(x) <= max_epochs * (1 + 1e-12), a)
    else:
        a = 1.0
    return MixPlan(a, spend(_weights(n, m, a)), float(n.max()), float((((n / n.max()) ** a) * m).sum()))


def solve(tokens: dict[str, int], *, entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS,
          budget: float | None = None) -> MixPlan:
    """Exponent, weights and token budgets from the tokens per source."""
    named = sorted((s, n) for s, n in tokens.items() if n > 0)
    t = np.asarray([n for _, n in named], np.float64)
    p = solve_counts(t, np.ones(len(t)), entropy_share=entropy_share, max_epochs=max_epochs, budget=budget)
    w = _weights(t, np.ones(len(t)), p.exponent).tolist() if named else []
    rows = [(s, n, x, p.budget * x) for (s, n), x in zip(named, w)]
    rows += [(s, 0, 0.0, 0.0) for s, n in sorted(tokens.items()) if n <= 0]
    return MixPlan(p.exponent, p.budget, p.top, p.norm, tuple(rows))


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast a written table of a row per source if it is small, else leave the join to a shuffle."""
    return F.broadcast(rows) if rows.count() <= SMALL_SOURCES else rows


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS, budget: float | None = None,
        block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, MixPlan]:
    """Returns (docs with ``mix_epochs``: how often the row is read, 0 or more, and ``mix_block``;
    plan). Extra columns of ``docs`` stay, unless they have one of these names."""
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    sizes = materialize(docs.select(src.alias("s"), F.col(id_col).cast("string").alias("i"),
                                    token_count(F.col(text_col)).alias("t"),
                                    F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")), "mix-sizes")
    per = materialize(sizes.groupBy("s").agg(F.sum("t").alias("t")), "mix-sources")
    few = per.limit(SMALL_SOURCES + 1).collect()
    kinds = per.filter("t > 0").groupBy("t").agg(F.count("*").alias("n")).orderBy("t").toArrow()
    plan = solve_counts(kinds.column("t").to_numpy(), kinds.column("n").to_numpy(), entropy_share=entropy_share, max_epochs=max_epochs, budget=budget)
    if len(few) <= SMALL_SOURCES:
        held = [(r.s, r.t, (r.t / plan.top) ** plan.exponent / plan.norm if r.t else 0.0) for r in sorted(few, key=lambda r: (r.t == 0, r.s))]
        plan = replace(plan, rows=tuple((s, n, x, plan.budget * x) for s, n, x in held))
    t, share = F.col("t"), F.pow(F.col("t") / F.lit(plan.top), F.lit(plan.exponent)) / F.lit(plan.norm)
    quota = per.withColumn("b", F.when(t > 0, F.lit(plan.budget) * share).otherwise(F.lit(0.0))) \
        .withColumn("epochs", F.when(t > 0, F.floor(F.col("b") / t + F.lit(1e-9))).otherwise(F.lit(1)).cast("int")) \
        .withColumn("over", F.when(t > 0, F.greatest(F.lit(0.0), F.col("b") - F.col("epochs") * t)).otherwise(F.lit(0.0)))
    quota = materialize(quota.select("s", "epochs", F.when(F.col("over") > 1e-6 * t, F.col("over")).otherwise(F.lit(0.0)).alias("rest"),
                                     F.greatest(F.lit(1), F.ceil(t / F.lit(block_tokens))).cast("int").alias("blocks")), "mix-quota")

    # the partial epoch: order the blocks, take those that fit, cut the one at the edge
    dealt = (sizes.join(_small(quota.filter("rest > 0")), "s")
             .withColumn("b", F.pmod(F.xxhash64(F.lit(SEED), "i", "h"), F.col("blocks"))))
    key = F.xxhash64(F.lit(SEED), "s", "epochs", "b")
    blocks = dealt.groupBy("s", "epochs", "rest", "b").agg(F.sum("t").alias("t")).withColumn("o", key)
    w = Window.partitionBy("s").orderBy("o", "b")
    edge = (blocks.withColumn("upto", F.sum("t").over(w)).withColumn("before", F.col("upto") - F.col("t"))
            .filter((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest")) & (F.col("t") > 0))
            .select("s", F.col("b").alias("edge_b"), F.col("o").alias("edge_o"), (F.col("rest") - F.col("before")).alias("left")))
    inner = F.xxhash64(F.lit(SEED + 1), "epochs", "i", "h")
    w2 = Window.partitionBy("s").orderBy("k", "i", "h").rowsBetween(Window.unboundedPreceding, -1)
    edge = materialize(edge, "mix-edge")
    cut = (dealt.join(_small(edge), "s").filter(F.col("b") == F.col("edge_b")).withColumn("k", inner)
           .withColumn("sum", F.coalesce(F.sum("t").over(w2), F.lit(0))).filter(F.col("sum") < F.col("left"))
           .groupBy("s").agg(F.max(F.struct("k", "i", "h")).alias("last")))
    # names that no column of docs begins with
    p = next(x for x in (f"mix{i}_" for i in range(len(docs.columns) + 1)) if not any(c.lower().startswith(x) for c in docs.columns))
    marks = quota.join(edge, "s", "left").join(cut, "s", "left").select(
        F.col("s").alias(p + "s"), F.col("epochs").alias(p + "e"), F.col("blocks").alias(p + "b"), F.col("edge_b").cast("long").alias(p + "x"),
        F.col("edge_o").alias(p + "o"), F.col("last.k").alias(p + "k"), F.col("last.i").alias(p + "i"), F.col("last.h").alias(p + "h"))
    marks = materialize(marks, "mix-marks")
    m = lambda n: F.col(p + n)
    i, h = F.col(id_col).cast("string"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    b = F.pmod(F.xxhash64(F.lit(SEED), i, h), m("b"))
    o = F.xxhash64(F.lit(SEED), m("s"), m("e"), b)
    k = F.xxhash64(F.lit(SEED + 1), m("e"), i, h)
    first = F.struct(o.alias("a"), b.alias("b")) < F.struct(m("o").alias("a"), m("x").alias("b"))
    inside = (b == m("x")) & (F.struct(k.alias("k"), i.alias("i"), h.alias("h"))
                              <= F.struct(m("k").alias("k"), m("i").alias("i"), m("h").alias("h")))
    partial = F.when(m("x").isNull(), 0).otherwise(F.when(first, 1).otherwise(F.coalesce(F.when(inside, 1), F.lit(0))))
    keep = [c for c in docs.columns if c.lower() not in ("mix_epochs", "mix_block", "mix_key")]
    out = docs.join(_small(marks), src == m("s")).select(
        *keep, (m("e") + partial).alias("mix_epochs"), b.alias("mix_block"), F.struct(i.alias("i"), h.alias("h")).alias("mix_key"))
    return out, plan


def realise(mixed: DataFrame) -> DataFrame:
    """One row per reading, numbered by ``mix_epoch``. Reading a source's rows in the order of
    (mix_epoch, mix_order) is its permutation: blocks in the epoch's order, then documents."""
    e = F.col("mix_epoch")
    s = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)) if "source" in mixed.columns else F.lit("")
    rows = mixed.filter("mix_epochs > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("mix_epochs"))))
    order = F.struct(F.xxhash64(F.lit(SEED), s, e - 1, F.col("mix_block")).alias("block"),
                     F.xxhash64(F.lit(SEED + 1), e - 1, F.col("mix_key.i"), F.col("mix_key.h")).alias("row"))
    return rows.withColumn("mix_order", order).drop("mix_epochs", "mix_key")
