"""Job lifecycle and request-log reports (J1-J6, O1-O3, O5) as folds over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import retry_delay, valid_request_id
from tessera.operators.ranking import range_running_sum

# The default bucket bounds (seconds) of a Prometheus client histogram.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
# Retry policy defaults: attempts, base delay and cap (seconds).
MAX_ATTEMPTS, RETRY_BASE, RETRY_CAP = 3, 2.0, 60.0


def job_state(events: DataFrame, job: str = "job_id", seq: str = "seq", state: str = "state",
              extra: list | None = None) -> DataFrame:
    """Current status = state of the latest lifecycle event; attempt = number of
    runs started (running events); first/last sequence numbers (+ ``extra`` aggregates)."""
    s = F.col(seq)
    return events.filter(F.col(state).isNotNull()).groupBy(job).agg(
        F.max_by(F.col(state), s).alias("status"),
        F.count_if(F.col(state) == "running").cast("int").alias("attempt"),
        F.min(s).alias("first_seq"), F.max(s).alias("last_seq"), *(extra or []),
    )


def status_counts(state: DataFrame) -> DataFrame:
    """Jobs per status (the id list is the state table itself, filtered by status)."""
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.min("job_id").alias("min_job_id"),
                                       F.max("job_id").alias("max_job_id"))


def dead_letter_report(dead_ids: DataFrame, state: DataFrame) -> DataFrame:
    """Dead-letter ids resolved to job records; ids without a record are dropped."""
    return dead_ids.distinct().join(state, "job_id", "inner")


# fixed values: error classes that are worth another attempt: OSError (TimeoutError and ConnectionError
# are among its subclasses) and RedisError of redis 5.2, each with its subclasses by name
TRANSIENT_ERRORS = (
    "OSError", "BlockingIOError", "ChildProcessError", "ConnectionError", "BrokenPipeError", "ConnectionAbortedError",
    "ConnectionRefusedError", "ConnectionResetError", "FileExistsError", "FileNotFoundError", "InterruptedError",
    "IsADirectoryError", "NotADirectoryError", "PermissionError", "ProcessLookupError", "TimeoutError",
    # of the standard library
    "gaierror", "herror", "SSLError", "SSLZeroReturnError", "SSLWantReadError", "SSLWantWriteError", "SSLSyscallError",
    "SSLEOFError", "SSLCertVerificationError", "URLError", "HTTPError", "ContentTooShortError",
    # of redis
    "RedisError", "AuthenticationError", "AuthorizationError", "BusyLoadingError", "MaxConnectionsError", "MasterNotFoundError",
    "SlaveNotFoundError", "InvalidResponse", "ResponseError", "DataError", "PubSubError", "WatchError", "NoScriptError",
    "OutOfMemoryError", "ExecAbortError", "ReadOnlyError", "NoPermissionError", "ModuleError", "LockError", "LockNotOwnedError",
    "AuthenticationWrongNumberOfArgsError", "ClusterError", "ClusterDownError", "AskError", "TryAgainError", "MovedError",
    "MasterDownError", "ClusterCrossSlotError")


# fixed values: a job is tried again if its error is one of these or derives from one
RETRYABLE_BASES = ("OSError", "TimeoutError", "ConnectionError", "RedisError")


def retry_plan(state: DataFrame, error_class: str = "error_class", max_attempts: int = MAX_ATTEMPTS,
               base: float = RETRY_BASE, cap: float = RETRY_CAP, ancestry: str | None = None) -> DataFrame:
    """Failed jobs whose error is a transient one and that have attempts left get a capped exponential delay.
    ``ancestry`` names a column with the names of the error's class and all classes it derives from, as the
    job record has them: any subclass counts, also the user's own. Without it (or where it is null) the class name
    is looked up among the known ones. A missing class is not retried."""
    failed = state.filter(F.col("status") == "failed")
    transient = F.col(error_class).isin(*TRANSIENT_ERRORS)
    if ancestry:
        bases = F.array(*[F.lit(b) for b in RETRYABLE_BASES])
        transient = F.when(F.col(ancestry).isNotNull(), F.arrays_overlap(F.col(ancestry), bases)).otherwise(transient)
    retryable = F.coalesce(transient, F.lit(False)) & (F.col("attempt") < max_attempts)
    return failed.select("job_id", "attempt", error_class, retryable.alias("retryable"),
                         F.when(retryable, retry_delay(F.col("attempt"), base, cap)).alias("delay_seconds"))


def actionable(state: DataFrame) -> DataFrame:
    """Queued jobs can be cancelled, failed jobs requeued."""
    action = F.when(F.col("status") == "queued", F.lit("cancel")).when(F.col("status") == "failed", F.lit("requeue"))
    return state.select("job_id", "status", action.alias("action")).filter(F.col("action").isNotNull())


def unacked(events: DataFrame, job: str = "job_id", seq: str = "seq", state: str = "state") -> DataFrame:
    """Jobs whose latest run started after their latest completion/failure.
    One grouped aggregate (linear per job even for a job with a huge history)."""
    s = F.col(seq)
    per = events.groupBy(job).agg(
        F.max(F.when(F.col(state) == "running", s)).alias("started_seq"),
        F.max(F.when(F.col(state).isin("completed", "failed"), s)).alias("_done"))
    return per.filter(F.col("started_seq").isNotNull() &
                      (F.col("_done").isNull() | (F.col("started_seq") > F.col("_done")))).drop("_done")


def log_counters(log: DataFrame, keys: list[str]) -> DataFrame:
    """O1: request counts per label set."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"))


def duration_histogram(log: DataFrame, duration: str, keys: list[str] | None = None,
                       buckets: tuple[float, ...] = DEFAULT_BUCKETS) -> DataFrame:
    """O2: cumulative bucket counts (le), +Inf, sum and count, one aggregate."""
    keys = keys or []
    d = F.col(duration)
    aggs = [F.count_if(d <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(F.lit(1)).alias("count"), F.sum(d).alias("sum")]
    wide = (log.groupBy(*keys) if keys else log).agg(*aggs)
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("h"), "count", "sum") \
        .select(*keys, "h.le", "h.cumulative", "count", "sum")


def active_gauge(events: DataFrame, order_cols: list[str], delta: str) -> DataFrame:
    """O3: the running sum of +1 (start) / -1 (finish) in the order of ``order_cols``, without a
    one-partition window; events of one time are split over tasks by the later columns."""
    return range_running_sum(events, order_cols, {"active": F.col(delta).cast("long")})


def request_id_check(log: DataFrame, candidate: str) -> DataFrame:
    """Accepted when 1..128 ASCII letters, digits, '-', '_' or '.'."""
    return log.withColumn("valid", valid_request_id(F.col(candidate)))
