"""Helpers shared by the operators of this folder: reading tables, the fold rule,
writing an intermediate table to the shared folder, and byte-level tokens.

Texts reach Python tasks as UTF-8 bytes. ``bytes.split()`` splits on exactly the six
bytes 0x20 and 0x09-0x0D, and ``bytes.lower()`` lowers exactly A-Z, so both are the
word rules of the contracts without a regular expression.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SPACE_REGEX = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 5 (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def utf8(text: Column) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back: later jobs
    reuse it, and a lost executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def chunks(rows: Iterable, weight, most: int) -> Iterator[list]:
    """Consecutive rows gathered until their weights pass ``most`` (at least one row)."""
    out, total = [], 0
    for r in rows:
        out.append(r)
        total += weight(r)
        if total >= most:
            yield out
            out, total = [], 0
    if out:
        yield out


def tidy() -> None:
    """Give memory that a finished task no longer uses back to the system: Python workers
    live on for later tasks beside the executor's heap."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):        # not glibc
        pass


def prepare(spark: SparkSession, rows: int = 2000, size: str = "4m") -> None:
    """For the queries and the pipeline: ship the package, and send whole texts to Python
    tasks at most ``rows`` or about ``size`` bytes at a time (the defaults of 10,000 rows
    and 64 MB hold too much per task where texts are long). A row is never cut."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python tasks (``addPyFile``), unless PYTHONPATH
    already names its folder. A cluster job would use ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tessera")):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(at)
    sc._tessera_shipped = True
