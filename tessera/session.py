"""Session helpers: building a session for tests/bench, the shared checkpoint folder,
and scratch paths under it (never a machine-local folder when the cluster names one)."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera") -> SparkSession:
    """Session for tests and the bench. The driver passes its own session to the
    queries; nothing in the library depends on settings made here except defaults."""
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when nothing is configured (local tests) do we create one ourselves."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- a remote (Connect) session exposes no SparkContext
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")  # only when the session names none (tests)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for tables a query writes."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-scratch/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def sql_conf(spark: SparkSession, **settings: str):
    """Set SQL confs for the duration of a block and restore the previous values."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    previous = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in previous.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def broadcast_limit_bytes(spark: SparkSession) -> int:
    """The session's broadcast threshold; operators that broadcast small derived
    tables check their estimated size against it before hinting."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        value = int(str(raw).lower().rstrip("b"))
    except ValueError:
        value = 10 * 1024 * 1024
    return value if value > 0 else 10 * 1024 * 1024


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python tasks (``addPyFile``), unless PYTHONPATH
    already names its folder. A cluster job would use ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera.zip")     # the driver's copy, sent to executors
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tessera")):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(at)
    sc._tessera_shipped = True
