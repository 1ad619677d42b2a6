"""Deterministic sharded WARC writer and reader.

Pages are dealt to shards by ranges of their id: the distinct ids are sorted, and every ``rows_per_shard``-th one
(more with over ``MAX_SHARDS`` ranges) starts a shard, however the ids are spread. An id that more rows
repeat is dealt on to parts of its shard by a hash of digest and url. Each part is sorted by id and written as
one gzip member per record; its file is rolled when its compressed size passes ``roll_bytes``. Headers and digests are made anew from the
payload. What lands in a file depends on the rows alone: record ids are derived from the
digest and id, dates are a parameter, and gzip headers carry no time.

A task writes each file under a temporary name and renames it when complete; a repeated
task writes the same bytes under the same final name. The rows it returns are the
manifest, which Spark commits as Parquet (``_manifest``); readers take only files that the
manifest names, so files of an unfinished run are never read.

Of records with equal payloads of at least ``revisit_bytes`` the one with the smallest
page id is a response and the others revisit it.

Defined results: null html is an empty payload; a null url is written as ``urn:no-url``;
null ids have a shard of their own, dealt to parts like a repeated id, and name no response unless all
are null (``refers_to`` is then null); among rows that repeat an id and payload one is the
response; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, utf8
from tessera.session import scratch_path, sql_conf

ROWS_PER_SHARD = 4096
MAX_SHARDS = 1 << 20         # their first ids are sent to the tasks (8 MB)
ROLL_BYTES = 16 << 20
REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
LEVEL = 5
SLICES = (4096, 1 << 16)      # compressed bytes fed at once: first, then
MANIFEST = "file string, shard long, part int, roll int, records long, bytes long, sha256 string, first_id long, last_id long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~-._") if not value.isascii() or any(c <= " " for c in value) else value


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    kind = "revisit" if revisit else "response"
    body = b"" if revisit else payload
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + body
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{digest}/{page_id}/{url}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_safe(url) if url else 'urn:no-url'}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)          # gzip frame; zlib writes no time into it
    return c.compress(data) + c.flush()


class _Roller:
    """Writes the records of one shard after another and rolls files by size."""

    def __init__(self, uri: str, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.roll_bytes, self.shard, self.out = roll_bytes, None, None

    def _open(self, shard: tuple[int, int], roll: int) -> None:
        self.shard, self.roll = shard, roll
        kind = "null" if shard[0] < 0 else "warc"
        self.name = f"{kind}-{abs(shard[0]):010d}-{shard[1]:05d}-{roll:05d}.warc.gz"
        self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.out, self.sha = self.fs.open_output_stream(self.temp), hashlib.sha256()
        self.bytes = self.records = 0
        self.first = None

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            yield (self.name, *self.shard, self.roll, self.records, self.bytes, self.sha.hexdigest(), self.first, self.last)
            self.out = None

    def add(self, shard: tuple[int, int], page_id: int | None, data: bytes) -> Iterator[tuple]:
        if self.out is None or shard != self.shard or self.bytes >= self.roll_bytes:
            roll = self.roll + 1 if shard == self.shard and self.out is not None else 0
            yield from self.close()
            self._open(shard, roll)
        packed = _gzip(data)
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)
        self.records += 1
        self.first, self.last = page_id if self.records == 1 else self.first, page_id


def _ranges(ids: DataFrame, rows_per_shard: int) -> tuple[list[int], DataFrame]:
    """First ids of all shards but the first, ascending, and (id, parts) of the ids to be dealt on (null among them)."""
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(ids.groupBy("id").agg(F.count("*").alias("n")).repartitionByRange(n, "id").sortWithinPartitions("id")
                         .withColumn("at", F.monotonically_increasing_id()), "warc-ids")      # numbered in order within a range
    known, part = counts.filter("id is not null"), F.shiftright("at", 33).alias("part")
    shifts, distinct = [], 0
    for r in known.groupBy(part).agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("part").collect():       # a row per range
        shifts.append((r.part, distinct - r["first"]))
        distinct += r.n
    step = max(rows_per_shard, -(-distinct // MAX_SHARDS))
    ranked = known.withColumn("part", part).join(F.broadcast(spark.createDataFrame(shifts, "part long, shift long")), "part")
    place = F.col("at") + F.col("shift")
    cuts = [r.id for r in ranked.filter((place > 0) & (place % step == 0)).select("id").collect()]                         # at most MAX_SHARDS
    many = counts.filter(F.col("n") > step).select(F.col("id").alias("many_id"), F.ceil(F.col("n") / F.lit(step)).cast("int").alias("parts"))
    return sorted(cuts), materialize(many, "warc-many")


def _cuts_up_to(id_col: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above the id: a binary search in one literal array."""
    if not cuts:
        return F.lit(0).cast("long")
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = F.element_at(held, F.least(mid + 1, F.lit(len(cuts)))) <= id_col
        done = at["lo"] >= at["hi"]
        return F.struct(F.when(~done & right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(~done & ~right, mid).otherwise(at["hi"]).alias("hi"))

    return F.aggregate(F.array_repeat(F.lit(0), len(cuts).bit_length() + 1), start, halve)["lo"].cast("long")


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          rows_per_shard: int = ROWS_PER_SHARD, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write the archive under ``path`` (a URI that all executors share) and return its manifest."""
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), utf8(F.col(html_col)).alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    # of each payload the smallest id (and url, for rows that repeat an id) is the response
    first = (p.select("id", "url", digest.alias("digest"), F.octet_length("payload").alias("n"))
             .filter(F.col("n") >= revisit_bytes).groupBy("digest")
             .agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", F.coalesce("url", F.lit("")).alias("u"))).alias("w"))
             .filter("copies > 1").select("digest", F.col("w.id").alias("to"), F.col("w.u").alias("to_url"), "copies"))
    first = materialize(first, "warc-responses")
    small = first.count() <= 50_000                          # checked: at most about 10 MB
    keyed = p.withColumn("digest", digest).join(F.broadcast(first) if small else first, "digest", "left")
    cuts, many = _ranges(p.select("id"), rows_per_shard)
    few = many.count() <= 50_000
    keyed = keyed.join(F.broadcast(many) if few else many, F.col("id").eqNullSafe(F.col("many_id")), "left")
    shard = F.when(F.col("id").isNull(), F.lit(-1).cast("long")).otherwise(_cuts_up_to(F.col("id"), cuts))
    salt = F.pmod(F.xxhash64("digest", F.coalesce("url", F.lit(""))), F.col("parts")).cast("int")
    # rows of a repeated id have parts of their own: 1, 2, ...
    rows = keyed.withColumn("shard", shard).withColumn("part", F.coalesce(salt + 1, F.lit(0))) \
        .repartition("shard", "part").sortWithinPartitions("shard", "part", "id", "url", "digest")
    _make_folder(spark, path)

    def run(batches):
        r, chosen = _Roller(path, roll_bytes), set()
        done: list[tuple] = []
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("shard", "part", "id", "url", "payload", "copies", "to", "to_url")]
            for sh, part, i, url, payload, copies, to, to_url in zip(*cols):
                d = payload_digest(payload)
                revisit = False
                if copies is not None:
                    here = i == to and (url or "") == to_url
                    revisit = not here or d in chosen        # rows equal in id, url and payload lie together
                    if here:
                        chosen.add(d)
                done += r.add((sh, part), i, record(i, url, payload, d, to if revisit else None, revisit))
        done += r.close()
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        cols = list(zip(*done)) if done else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in MANIFEST.split(", ")])

    with sql_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
        rows.select("shard", "part", "id", "url", "payload", "copies", "to", "to_url").mapInArrow(run, MANIFEST) \
            .write.mode("errorifexists").parquet(f"{path}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def _make_folder(spark: SparkSession, path: str) -> None:
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)


@dataclass(frozen=True)
class Parsed:
    head: dict[str, str]
    block: bytes


def parse(data: bytes) -> Iterator[Parsed]:
    """Records of a .warc.gz file, one gzip member after another. A member is fed in slices: what is left of a
    slice at its end is copied, so the work grows with the file and not with its square."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        d, parts, size = zlib.decompressobj(31), [], SLICES[0]
        while not d.eof and at < len(data):
            parts.append(d.decompress(view[at:at + size]))
            at, size = min(at + size, len(data)), SLICES[1]
        if not d.eof:
            raise ValueError("a gzip member is cut off")
        at -= len(d.unused_data)
        raw = b"".join(parts)
        top, _, rest = raw.partition(b"\r\n\r\n")
        lines = top.decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        if lines[0] != "WARC/1.1" or len(rest) != n + 4:
            raise ValueError("a record is malformed")
        yield Parsed(head, rest[:n])


RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
           "file string, digest_ok boolean, payload binary")


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Rows of RECORDS of an archive, from the files its manifest names. Digests of blocks
    and of response payloads are worked out again. A file is at most one roll long."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    files = files.join(manifest.select("file"), "file", "left_semi")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for r in parse(data):
                    h = r.head
                    http, _, body = r.block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    ok = h["WARC-Block-Digest"] == "sha1:" + payload_digest(r.block)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        ok = ok and digest == payload_digest(body) and size == len(body)
                    rows.append((_int(h.get("X-Page-Id")), size, digest, h["WARC-Type"], _int(h.get("X-Refers-To-Page-Id")),
                                 h["WARC-Target-URI"], name, ok, body if payloads else b""))
                    if len(rows) >= 2000:
                        yield _record_batch(rows)
                        rows = []
                yield _record_batch(rows)

    return files.select("file", "content").mapInArrow(run, RECORDS)


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
    cols = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in RECORDS.split(", ")])


def archive_path(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, as a URI."""
    path = scratch_path(spark, "warc")
    return path if "://" in path else ("file://" + path.removeprefix("file:") if path.startswith("file:") else "file://" + os.path.abspath(path))
