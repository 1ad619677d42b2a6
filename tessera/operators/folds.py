"""Shuffled k-fold assignment (C1) and stratified k-fold assignment.

The shuffle is an md5 of (seed, key), reproducible by any SQL engine; the fold is the
global rank modulo k, so fold sizes differ by at most one. Ranks come from bucketed
running sums (no one-partition window). Stratified folds rank inside each class after
the classes before it, which keeps every class and the total balanced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import global_rank, global_rank_with_copies


def kfold_assign(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 42,
                 fold_col: str = "fold", unique_keys: bool = True) -> DataFrame:
    """``unique_keys=False`` when the key may repeat (e.g. whole rows with copies): the
    copies-safe ranking spreads a hot group over tasks."""
    rank = global_rank if unique_keys else global_rank_with_copies
    ranked = rank(df, key_cols, seed=seed, rank_col="_rank")
    return ranked.withColumn(fold_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def stratified_kfold_assign(df: DataFrame, key_cols: list[str], label: str, k: int = 5, seed: int = 42,
                            fold_col: str = "fold", unique_keys: bool = True) -> DataFrame:
    rank = global_rank if unique_keys else global_rank_with_copies
    ranked = rank(df, key_cols, seed=seed, strata=[label], rank_col="_rank")
    return ranked.withColumn(fold_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
