"""Model and dataset registries as folds over append-only event logs.

State is never rewritten in place: registering, renaming, changing status and
unregistering are appended events, and the current state is one grouped aggregate
(latest value per attribute by sequence number). ``max_by`` is a declarative
aggregate with map-side partial aggregation, so a model with a huge event history
costs nothing extra in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# event kinds
REGISTER, SET_STATUS, RENAME, UNREGISTER, UPDATE = "register", "set_status", "rename", "unregister", "update_manifest"


def _trimmed(name: str):
    """The name without white space at its ends (tabs and line ends too)."""
    return F.btrim(F.col(name), F.lit(" \t\n\r\x0b\x0c"))


def registry_state(events: DataFrame, id_col: str = "model_id", seq: str = "seq") -> DataFrame:
    """Fold (id, seq, kind, name, status) events into one row per id:
    name (trimmed, latest register/rename/update), status (latest register -> active or
    set_status), present (latest register/unregister is a register), registered_seq. If the events have them:
    manifest (a map of text; that of the latest register or update, with the current name in it), package_name and
    registered_at of the latest register."""
    kind = F.col("kind")
    s = F.col(seq)
    life = kind.isin(REGISTER, UNREGISTER)
    named = kind.isin(REGISTER, RENAME, UPDATE) & F.col("name").isNotNull()
    status = F.when(kind == REGISTER, F.lit("active")).when(kind == SET_STATUS, F.col("status"))
    registered = F.when(kind == REGISTER, s)
    extra = [F.max_by(c, registered).alias(c) for c in ("package_name", "registered_at") if c in events.columns]
    if "manifest" in events.columns:
        extra.append(F.max_by("manifest", F.when(kind.isin(REGISTER, UPDATE) & F.col("manifest").isNotNull(), s)).alias("manifest"))
    state = events.groupBy(id_col).agg(
        F.max_by(_trimmed("name"), F.when(named, s)).alias("name"),
        F.max_by(status, F.when(status.isNotNull(), s)).alias("status"),
        (F.max_by(kind, F.when(life, s)) == REGISTER).alias("present"),
        F.max(registered).alias("registered_seq"), *extra)
    if "manifest" not in events.columns:
        return state
    rest = F.map_filter("manifest", lambda k, _: k != "name")
    return state.withColumn("manifest", F.when(F.col("manifest").isNotNull(), F.map_concat(rest, F.create_map(F.lit("name"), F.col("name")))))


def active_models(state: DataFrame) -> DataFrame:
    """Present and active."""
    return state.filter(F.col("present") & (F.col("status") == "active"))


def registry_list(state: DataFrame) -> DataFrame:
    """Every present model (any status) with its sort key lower(name)."""
    return state.filter(F.col("present")).withColumn("sort_key", F.lower("name")).orderBy("sort_key", "model_id")


def name_lookup(lookups: DataFrame, state: DataFrame, name_col: str = "lookup_name",
                id_col: str = "model_id") -> DataFrame:
    """Trim + casefold equality against active models; the first model by
    registration order wins among duplicates. Lookups without a match keep a null id."""
    act = active_models(state).select(F.lower(_trimmed("name")).alias("_k"), id_col, "registered_seq")
    first = act.groupBy("_k").agg(F.min_by(id_col, "registered_seq").alias(id_col))
    return (lookups.withColumn("_k", F.lower(_trimmed(name_col)))
            .join(first, "_k", "left").drop("_k"))


def publish_names(state: DataFrame, name_col: str = "name", id_col: str = "model_id") -> DataFrame:
    """The published package name '<name>-<first 8 chars of id>'."""
    return state.withColumn("package_name", F.concat_ws("-", F.col(name_col), F.substring(F.col(id_col), 1, 8)))


def remove_ids(state: DataFrame, ids: DataFrame, id_col: str = "model_id") -> DataFrame:
    """Bulk delete = anti join of the state with the id list."""
    return state.join(ids.select(id_col).distinct(), id_col, "left_anti")
