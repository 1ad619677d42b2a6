"""Registry queries (G1-G11, O4): folds over a model event log derived from events.

Fixed derivation rule (both engines): model_id = md5('model-' || user_id), seq = event_id;
signup -> register (name ' Model <user_id % 50> ', package 'pkg-<user_id % 9>', version '1.<event_id % 7>', target
'col_<user_id % 3>', registered_at = ts), view -> set_status ('disabled' when
value > 250 else 'active'), purchase -> rename ('Renamed <event_id % 97>'), click with event_id % 6 = 0 -> update_manifest
(name 'Updated <event_id % 31>', version '2.<event_id % 5>', target 'new_<user_id % 4>'), error -> unregister; other click
events are not registry events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import registry as G
from tessera.plans.catalog import query
from tessera.plans.fixtures import table


def model_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter((F.col("event_type") != "click") | (F.col("event_id") % 6 == 0))
    et, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    kind = (F.when(et == "signup", F.lit(G.REGISTER)).when(et == "view", F.lit(G.SET_STATUS)).when(et == "click", F.lit(G.UPDATE))
            .when(et == "purchase", F.lit(G.RENAME)).when(et == "error", F.lit(G.UNREGISTER)))
    name = (F.when(et == "signup", F.concat(F.lit(" Model "), (F.col("user_id") % 50).cast("string"), F.lit(" ")))
            .when(et == "purchase", F.concat(F.lit("Renamed "), (F.col("event_id") % 97).cast("string")))
            .when(et == "click", F.concat(F.lit("Updated "), (event % 31).cast("string"))))

    def manifest(version, modulus, target, of):
        return F.create_map(F.lit("name"), name, F.lit("version"), F.concat(F.lit(version), (event % modulus).cast("string")),
                            F.lit("target"), F.concat(F.lit(target), (user % of).cast("string")))

    manifests = F.when(et == "signup", manifest("1.", 7, "col_", 3)).when(et == "click", manifest("2.", 5, "new_", 4))
    status = F.when(et == "view", F.when(F.col("value") > 250, F.lit("disabled")).otherwise(F.lit("active")))
    return e.select(F.md5(F.concat(F.lit("model-"), F.col("user_id").cast("string"))).alias("model_id"),
                    F.col("event_id").alias("seq"), kind.alias("kind"), name.alias("name"), status.alias("status"),
                    manifests.alias("manifest"), F.when(et == "signup", F.concat(F.lit("pkg-"), (user % 9).cast("string"))).alias("package_name"),
                    F.when(et == "signup", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("registered_at"))


STATE_SQL = """
ev AS (SELECT md5('model-' || CAST(user_id AS VARCHAR)) AS model_id, event_id AS seq,
              CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'set_status'
                              WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'unregister' WHEN 'click' THEN 'update_manifest' END AS kind,
              CASE WHEN event_type = 'signup' THEN ' Model ' || CAST(user_id % 50 AS VARCHAR) || ' '
                   WHEN event_type = 'purchase' THEN 'Renamed ' || CAST(event_id % 97 AS VARCHAR)
                   WHEN event_type = 'click' THEN 'Updated ' || CAST(event_id % 31 AS VARCHAR) END AS name,
              CASE event_type WHEN 'signup' THEN '1.' || CAST(event_id % 7 AS VARCHAR) WHEN 'click' THEN '2.' || CAST(event_id % 5 AS VARCHAR) END AS version,
              CASE event_type WHEN 'signup' THEN 'col_' || CAST(user_id % 3 AS VARCHAR) WHEN 'click' THEN 'new_' || CAST(user_id % 4 AS VARCHAR) END AS target,
              'pkg-' || CAST(user_id % 9 AS VARCHAR) AS package_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS registered_at,
              CASE WHEN event_type = 'view' THEN CASE WHEN value > 250 THEN 'disabled' ELSE 'active' END END AS status
       FROM events WHERE event_type <> 'click' OR event_id % 6 = 0),
state AS (SELECT model_id,
                 arg_max(trim(name), seq) FILTER (WHERE kind IN ('register', 'rename', 'update_manifest') AND name IS NOT NULL) AS name,
                 arg_max(version, seq) FILTER (WHERE kind IN ('register', 'update_manifest')) AS version,
                 arg_max(target, seq) FILTER (WHERE kind IN ('register', 'update_manifest')) AS target,
                 arg_max(package_name, seq) FILTER (WHERE kind = 'register') AS package_name,
                 arg_max(registered_at, seq) FILTER (WHERE kind = 'register') AS registered_at,
                 arg_max(CASE WHEN kind = 'register' THEN 'active' ELSE status END, seq)
                     FILTER (WHERE kind = 'register' OR (kind = 'set_status' AND status IS NOT NULL)) AS status,
                 arg_max(kind, seq) FILTER (WHERE kind IN ('register', 'unregister')) = 'register' AS present,
                 max(seq) FILTER (WHERE kind = 'register') AS registered_seq
          FROM ev GROUP BY model_id)"""


def state(spark, sf_dir):
    s = G.registry_state(model_events(spark, sf_dir))
    return s.withColumns({"version": F.col("manifest")["version"], "target": F.col("manifest")["target"]})


@query("registry_latest", f"""WITH {STATE_SQL}
SELECT *, CASE WHEN version IS NOT NULL THEN name END AS manifest_name FROM state""")
def q_registry_latest(spark, sf_dir):
    return state(spark, sf_dir).withColumn("manifest_name", F.col("manifest")["name"]).drop("manifest")


@query("registry_active", f"""WITH {STATE_SQL}
SELECT model_id, name, (SELECT count(*) FROM state WHERE present AND status = 'active') AS active_count
FROM state WHERE present AND status = 'active'""")
def q_registry_active(spark, sf_dir):
    act = G.active_models(state(spark, sf_dir))
    # the gauge (O4) rides along as a scalar subquery over the same fold
    return act.select("model_id", "name", act.agg(F.count(F.lit(1))).scalar().alias("active_count"))


LOOKUP_SQL = """lk AS (SELECT c_custkey AS lookup_id,
       CASE c_custkey % 3 WHEN 0 THEN '  MODEL ' || CAST(c_custkey % 60 AS VARCHAR) || '  '
                          WHEN 1 THEN 'model ' || CAST(c_custkey % 60 AS VARCHAR)
                          ELSE 'RENAMED ' || CAST(c_custkey % 100 AS VARCHAR) END AS lookup_name FROM customer)"""


def lookups(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = (F.when(k % 3 == 0, F.concat(F.lit("  MODEL "), (k % 60).cast("string"), F.lit("  ")))
            .when(k % 3 == 1, F.concat(F.lit("model "), (k % 60).cast("string")))
            .otherwise(F.concat(F.lit("RENAMED "), (k % 100).cast("string"))))
    return c.select(k.alias("lookup_id"), name.alias("lookup_name"))


@query("registry_name_lookup", f"""WITH {STATE_SQL}, {LOOKUP_SQL},
firsts AS (SELECT lower(trim(name)) AS k, arg_min(model_id, registered_seq) AS model_id
           FROM state WHERE present AND status = 'active' GROUP BY 1)
SELECT lk.lookup_id, lk.lookup_name, firsts.model_id FROM lk LEFT JOIN firsts ON firsts.k = lower(trim(lk.lookup_name))""")
def q_registry_name_lookup(spark, sf_dir):
    return G.name_lookup(lookups(spark, sf_dir), state(spark, sf_dir))


@query("registry_list", f"WITH {STATE_SQL} SELECT *, lower(name) AS sort_key FROM state WHERE present")
def q_registry_list(spark, sf_dir):
    return G.registry_list(state(spark, sf_dir)).drop("manifest")


@query("publish_names", f"""WITH {STATE_SQL}
SELECT model_id, name || '-' || substr(model_id, 1, 8) AS package_name FROM state WHERE present AND status = 'active'""")
def q_publish_names(spark, sf_dir):
    return G.publish_names(G.active_models(state(spark, sf_dir))).select("model_id", "package_name")


@query("models_anti_join", f"""WITH {STATE_SQL},
del AS (SELECT DISTINCT md5('model-' || CAST(s_suppkey % 200 AS VARCHAR)) AS model_id FROM supplier)
SELECT model_id, name FROM state WHERE present AND model_id NOT IN (SELECT model_id FROM del)""")
def q_models_anti_join(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").select(
        F.md5(F.concat(F.lit("model-"), (F.col("s_suppkey") % 200).cast("string"))).alias("model_id"))
    st = state(spark, sf_dir).filter(F.col("present"))
    return G.remove_ids(st, ids).select("model_id", "name")


# Dataset events: dataset 'ds-<user_id % 40>'; signup -> register (' dataset <user_id> '),
# purchase -> rename ('Sales <event_id % 13>'), error with event_id % 5 = 0 -> delete.
@query("dataset_latest", """
WITH ev AS (SELECT 'ds-' || CAST(user_id % 40 AS VARCHAR) AS dataset_id, event_id AS seq,
                   CASE WHEN event_type = 'signup' THEN 'register' WHEN event_type = 'purchase' THEN 'rename'
                        WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'unregister' END AS kind,
                   CASE WHEN event_type = 'signup' THEN ' dataset ' || CAST(user_id AS VARCHAR) || ' '
                        WHEN event_type = 'purchase' THEN 'Sales ' || CAST(event_id % 13 AS VARCHAR) END AS name
            FROM events)
SELECT dataset_id,
       arg_max(trim(name), seq) FILTER (WHERE kind IN ('register', 'rename') AND name IS NOT NULL) AS name,
       arg_max(kind, seq) FILTER (WHERE kind IN ('register', 'unregister')) = 'register' AS present
FROM ev WHERE kind IS NOT NULL GROUP BY dataset_id""")
def q_dataset_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    kind = (F.when(et == "signup", F.lit(G.REGISTER)).when(et == "purchase", F.lit(G.RENAME))
            .when((et == "error") & (F.col("event_id") % 5 == 0), F.lit(G.UNREGISTER)))
    name = (F.when(et == "signup", F.concat(F.lit(" dataset "), F.col("user_id").cast("string"), F.lit(" ")))
            .when(et == "purchase", F.concat(F.lit("Sales "), (F.col("event_id") % 13).cast("string"))))
    ev = e.select(F.concat(F.lit("ds-"), (F.col("user_id") % 40).cast("string")).alias("dataset_id"),
                  F.col("event_id").alias("seq"), kind.alias("kind"), name.alias("name"),
                  F.lit(None).cast("string").alias("status")).filter(F.col("kind").isNotNull())
    return G.registry_state(ev, id_col="dataset_id").select("dataset_id", "name", "present")
