"""Job-log and request-log queries (J1-J6, O1-O3, O5) over events read as a lifecycle log.

Fixed derivation rule (both engines): job_id = user_id, seq = event_id,
state = signup -> queued, view -> running, purchase -> completed, error -> failed
(click is log noise); error classes of a failure (the class, then what it derives from) by
event_id % 6, see ERRORS; request duration = value / 100 seconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joblog as J
from tessera.plans.catalog import query
from tessera.plans.fixtures import LIFECYCLE_SQL, lifecycle_state, table


# by event_id % 6: a built-in subclass, a subclass of the user's own, the base itself, a redis one, no transient one, none recorded
ERRORS = (("ConnectionResetError", "ConnectionError", "OSError"), ("UploadStalled", "TimeoutError", "OSError"), ("OSError",),
          ("BusyLoadingError", "ConnectionError", "RedisError"), ("ValidationError", "ValueError"), None)


def job_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    classes = F.element_at(F.array(*[F.lit(None).cast("array<string>") if c is None else F.array(*[F.lit(x) for x in c]) for c in ERRORS]),
                           (F.col("event_id") % 6).cast("int") + 1)
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"),
                    lifecycle_state(F.col("event_type")).alias("state"),
                    F.struct(classes.alias("error_classes")).alias("error"),
                    "ts", "value", "event_type", "event_id", "props")


def _state(spark, sf_dir):
    ev = job_events(spark, sf_dir)
    last_err = F.max_by(F.col("error"), F.when(F.col("state") == "failed", F.col("seq")))["error_classes"].alias("error_classes")
    return J.job_state(ev, extra=[last_err]).withColumn("error_class", F.get("error_classes", F.lit(0)))


JOBS_SQL = f"""
ev AS (SELECT user_id AS job_id, event_id AS seq, {LIFECYCLE_SQL} AS state,
              {{'c': [{", ".join("NULL" if c is None else "[" + ", ".join(f"'{x}'" for x in c) + "]" for c in ERRORS)}][event_id % 6 + 1]}} AS error
       FROM events),
st AS (SELECT job_id, arg_max(state, seq) AS status, CAST(count_if(state = 'running') AS INTEGER) AS attempt,
              min(seq) AS first_seq, max(seq) AS last_seq,
              arg_max(error, seq) FILTER (WHERE state = 'failed').c AS error_classes
       FROM ev WHERE state IS NOT NULL GROUP BY job_id)"""


@query("job_state_fold", f"WITH {JOBS_SQL} SELECT job_id, status, attempt, first_seq, last_seq FROM st")
def q_job_state_fold(spark, sf_dir):
    return _state(spark, sf_dir).drop("error_class", "error_classes")


@query("job_status_counts", f"""WITH {JOBS_SQL}
SELECT status, count(*) AS jobs, min(job_id) AS min_job_id, max(job_id) AS max_job_id FROM st GROUP BY status""")
def q_job_status_counts(spark, sf_dir):
    return J.status_counts(_state(spark, sf_dir))


@query("dead_letter_report", f"""WITH {JOBS_SQL},
dl AS (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN user_id + 100000 ELSE user_id END AS job_id
       FROM events WHERE event_type = 'error')
SELECT st.job_id, st.status, st.attempt FROM dl JOIN st ON st.job_id = dl.job_id""")
def q_dead_letter_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    dl = e.select(F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 100000).otherwise(F.col("user_id")).alias("job_id"))
    return J.dead_letter_report(dl, _state(spark, sf_dir)).select("job_id", "status", "attempt")


@query("retry_plan", f"""WITH {JOBS_SQL}
SELECT job_id, attempt, error_classes[1] AS error_class, t AND attempt < 3 AS retryable,
       CASE WHEN t AND attempt < 3 THEN least(2.0 * pow(2.0, greatest(attempt - 1, 0)), 60.0) END AS delay_seconds
FROM (SELECT *, coalesce(list_has_any(error_classes, ['OSError', 'TimeoutError', 'ConnectionError', 'RedisError']), false) AS t FROM st)
WHERE status = 'failed'""")
def q_retry_plan(spark, sf_dir):
    return J.retry_plan(_state(spark, sf_dir), ancestry="error_classes")


@query("job_actionable", f"""WITH {JOBS_SQL}
SELECT job_id, status, CASE status WHEN 'queued' THEN 'cancel' ELSE 'requeue' END AS action
FROM st WHERE status IN ('queued', 'failed')""")
def q_job_actionable(spark, sf_dir):
    return J.actionable(_state(spark, sf_dir))


@query("job_unacked", f"""WITH {JOBS_SQL},
per AS (SELECT job_id, max(seq) FILTER (WHERE state = 'running') AS started_seq,
               max(seq) FILTER (WHERE state IN ('completed', 'failed')) AS done FROM ev GROUP BY job_id)
SELECT job_id, started_seq FROM per WHERE started_seq IS NOT NULL AND (done IS NULL OR started_seq > done)""")
def q_job_unacked(spark, sf_dir):
    return J.unacked(job_events(spark, sf_dir))


REQUEST_LOG_SQL = """
rl AS (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
              '/api/' || event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
              value / 100.0 AS duration, event_id, ts, props FROM events)"""


def request_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(F.when(et.isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
                    F.concat(F.lit("/api/"), et).alias("route"),
                    F.when(et == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
                    (F.col("value") / 100.0).alias("duration"), "event_id", "ts", "props")


@query("log_counters", f"WITH {REQUEST_LOG_SQL} SELECT method, route, status, count(*) AS requests FROM rl GROUP BY ALL")
def q_log_counters(spark, sf_dir):
    return J.log_counters(request_log(spark, sf_dir), ["method", "route", "status"])


def _hist_sql():
    parts = [f"SELECT method, '{b}' AS le, count_if(duration <= {b}) AS cumulative, count(*) AS count, "
             f"round(sum(duration), 6) AS sum FROM rl GROUP BY method" for b in J.DEFAULT_BUCKETS]
    parts.append("SELECT method, '+Inf', count(*), count(*), round(sum(duration), 6) FROM rl GROUP BY method")
    return f"WITH {REQUEST_LOG_SQL}\n" + "\nUNION ALL\n".join(parts)


@query("log_duration_histogram", _hist_sql())
def q_log_duration_histogram(spark, sf_dir):
    h = J.duration_histogram(request_log(spark, sf_dir), "duration", ["method"])
    return h.withColumn("sum", F.round("sum", 6))


@query("log_active_gauge", f"""
SELECT event_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 WHEN 'error' THEN -1 ELSE 0 END)
       OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM events""")
def q_log_active_gauge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    delta = F.when(et == "view", F.lit(1)).when(et.isin("purchase", "error"), F.lit(-1)).otherwise(F.lit(0))
    return J.active_gauge(e.select("event_id", "ts", delta.alias("delta")), ["ts", "event_id"], "delta") \
        .select("event_id", "active")


# Request-id candidates by rule: event_id % 5 -> 0 md5 hex, 1 'req-<id>', 2 'bad id <id>',
# 3 130 x 'a' (too long), 4 the raw props JSON (braces, quotes, spaces).
@query("log_valid_request_id", r"""
WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN md5(CAST(event_id AS VARCHAR)) WHEN 1 THEN 'req-' || CAST(event_id AS VARCHAR)
                                 WHEN 2 THEN 'bad id ' || CAST(event_id AS VARCHAR) WHEN 3 THEN repeat('a', 130) ELSE props END AS request_id
           FROM events)
SELECT event_id, coalesce(regexp_matches(request_id, '^[A-Za-z0-9._-]{1,128}$'), false) AS valid FROM c""")
def q_log_valid_request_id(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    cand = (F.when(i % 5 == 0, F.md5(i.cast("string"))).when(i % 5 == 1, F.concat(F.lit("req-"), i.cast("string")))
            .when(i % 5 == 2, F.concat(F.lit("bad id "), i.cast("string"))).when(i % 5 == 3, F.repeat(F.lit("a"), 130))
            .otherwise(F.col("props")))
    return J.request_id_check(e.select("event_id", cand.alias("request_id")), "request_id").select("event_id", "valid")


@query("stream_job_state", f"WITH {JOBS_SQL} SELECT job_id, status, attempt, first_seq, last_seq FROM st")
def q_stream_job_state(spark, sf_dir):
    """J3 as a streaming aggregation over the events table read as a file stream."""
    from tessera.session import scratch_path
    from tessera.streaming.scoring import compact_job_state, job_state_stream, read_job_state
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")  # a glob: file streams watch folders
    ev = stream.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"),
                       lifecycle_state(F.col("event_type")).alias("state"))
    out, ck = scratch_path(spark, "job_state"), scratch_path(spark, "job_state_ck")
    job_state_stream(ev, out, ck).awaitTermination()
    compact_job_state(spark, out)
    return read_job_state(spark, out)
