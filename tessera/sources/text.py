"""Text-table reader (S1, S2) and writer.

Reading is: detect the encoding with one distributed scan, find the records, read every cell as a
string (no schema inference on raw text), turn NA tokens into nulls, then infer each column's
type with one aggregate and cast in one projection. Rows longer than the header are
corrupt records and fail the read; short rows are padded with nulls.

A quoted cell may hold line ends, and files are still read in splits. Whether a line starts inside a quoted
cell depends on all lines before it, but a run of lines can only map the two possible states (outside, inside)
to two states. So one scan of the lines that hold a quote gives that map for every split, maps of a file's
splits are composed in order (a few bytes a split), and each split is then cut into records on its own. What a split
cannot finish, the record that crosses its end, is put together from pieces by file and position. Where no line
ends inside a cell every line is a record and Spark's own reader is used.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import na_token_to_null, q
from tessera.operators.profile import apply_types, infer_aggs, type_from_counts
from tessera.operators.score import ValidationError
from tessera.session import ship

# The encodings tried in order for datasets, and for scoring files.
DATASET_ENCODINGS = ("utf-8-sig", "utf-8", "cp950", "big5")
SCORING_ENCODINGS = ("utf-8",)
# Java charset names for the encodings Python calls cp950 / big5
_JAVA_CHARSET = {"cp950": "MS950", "big5": "Big5", "utf-8": "UTF-8", "utf-8-sig": "UTF-8"}
CORRUPT = "_corrupt_record"


def dedupe_header(names: list[str]) -> list[str]:
    """Repeated header names get '.1', '.2', ... in order of appearance."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            cand = f"{n}.{seen[n]}"
            while cand in seen:
                seen[n] += 1
                cand = f"{n}.{seen[n]}"
            out.append(cand)
            seen[cand] = 0
        else:
            seen[n] = 0
            out.append(n)
    return out


def detect_encoding(spark: SparkSession, path: str, encodings=DATASET_ENCODINGS) -> str:
    """First encoding of ``encodings`` that decodes every line. One aggregate per
    candidate over the raw lines; UTF-8 validity is checked on the raw bytes, the
    legacy Chinese code pages by the absence of replacement characters."""
    raw = spark.read.text(path)
    if raw.limit(1).count() == 0:
        raise ValidationError("empty input")
    for enc in encodings:
        if enc.startswith("utf-8"):
            ok = raw.agg(F.coalesce(F.min(F.is_valid_utf8("value").cast("int")), F.lit(1)).alias("ok")).first()["ok"]
            if ok == 1:
                return enc
            continue
        allow_java_charsets(spark)
        decoded = (spark.read.option("encoding", _JAVA_CHARSET[enc]).option("header", False)
                   .option("sep", "\u0001").csv(path))
        bad = decoded.agg(F.count_if(F.col(decoded.columns[0]).contains("\ufffd")).alias("bad")).first()["bad"]
        if bad == 0:
            return enc
    raise ValidationError(f"input cannot be decoded as any of {', '.join(encodings)}")


def allow_java_charsets(spark: SparkSession) -> None:
    """Legacy code pages (MS950, Big5) need ``spark.sql.legacy.javaCharsets``. Reads are
    lazy, so the setting must hold while the returned DataFrame runs: it is switched on
    for the session (it only widens the accepted charset names) and never switched off."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


# ------------------------------------------------------------------ records
def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends inside a quoted cell. A quote opens a cell at its start only; a doubled one inside is a
    quote; what follows a closing quote belongs to the cell."""
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(sep + '"')
            if at < 0:
                return False
            at += len(sep)
        at += 1
    while True:
        end = line.find('"', at)
        while end >= 0 and line.startswith('"', end + 1):
            end = line.find('"', end + 2)
        if end < 0:
            return True
        at = line.find(sep + '"', end + 1)
        if at < 0:
            return False
        at += len(sep) + 1


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, block (where its split starts), line: in the files' order within a split."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    if not encoding.startswith("utf-8"):
        allow_java_charsets(spark)
        return raw.select("file", "block", F.decode(F.col("value").cast("binary"), _JAVA_CHARSET[encoding]).alias("line"))
    line = F.when((F.col("block") == 0) & F.startswith(F.col("value"), F.lit("\ufeff")), F.substring("value", 2, 2147483647)).otherwise(F.col("value"))
    return raw.select("file", "block", line.alias("line"))


def _split_states(sep: str):
    """(file, block, states after the block when it starts outside and inside, whether a line that starts outside ends inside)."""
    def run(batches):
        key, out, inn, opens, rows = None, False, True, False, []
        for b in batches:
            for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != key:
                    if key:
                        rows.append((*key, out, inn, opens))
                    key, out, inn, opens = (file, block), False, True, False
                after = {state: ends_inside(line, state, sep) for state in {out, inn}}
                opens = opens or any(after[x] and not x for x in after)
                out, inn = after[out], after[inn]
        if key:
            rows.append((*key, out, inn, opens))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))],
                                         ["file", "block", "out", "inn", "opens"])

    return run


def _cut_records(sep: str, started_inside):
    """Whole records (piece null) and the pieces of those that cross an end of a split: 0 ends one, 1 lies within
    one, 2 starts one. The first record of a file, its header, has ``first``."""
    names, types = ["file", "block", "piece", "first", "record"], [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches):
        key, inside, held, piece, first, rows = None, False, [], None, False, []

        def close():
            # the block ends: what is held started here (2) or runs through (1)
            if inside:
                rows.append((*key, 2 if piece is None else 1, first, "\n".join(held)))

        for b in batches:
            for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != key:
                    if key:
                        close()
                    key = (file, block)
                    inside = key in started_inside.value
                    held, piece, first = [], 0 if inside else None, block == 0
                if not inside and not line.strip():
                    continue
                inside = ends_inside(line, inside, sep)
                held.append(line)
                if not inside:
                    rows.append((*key, piece, first, "\n".join(held)))
                    held, piece, first = [], None, False
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows.clear()
        if key:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def records(spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",") -> DataFrame | None:
    """(file, first, record): one row per record, line ends inside cells as \\n; None where every line is a record.
    Raises ValidationError if a file ends inside a quoted cell."""
    ship(spark)
    lines = _lines(spark, path, encoding)
    quoted = F.contains("line", F.lit('"'))
    blocks = lines.filter(quoted).mapInArrow(_split_states(sep), "file string, block long, out boolean, inn boolean, opens boolean")
    quiet = lines.groupBy("file", "block").agg(F.max(quoted).alias("quoted")).filter("not quoted")       # these change no state
    blocks = blocks.unionByName(quiet.select("file", "block", F.lit(False).alias("out"), F.lit(True).alias("inn"), F.lit(False).alias("opens")))
    # a file's splits in order: a row each, of which only those that start inside a cell are sent to the driver
    start = F.struct(F.lit(False).alias("now"), F.array().cast("array<bigint>").alias("inside"))
    scan = F.aggregate(F.array_sort(F.collect_list(F.struct("block", "out", "inn"))), start, lambda acc, x: F.struct(
        F.when(acc["now"], x["inn"]).otherwise(x["out"]).alias("now"),
        F.when(acc["now"], F.concat(acc["inside"], F.array(x["block"]))).otherwise(acc["inside"]).alias("inside")))
    files = blocks.groupBy("file").agg(F.max("opens").alias("opens"), scan.alias("s"))
    spans = files.filter("opens").select("file", "s.now", "s.inside").collect()
    if not spans:
        return None
    if any(r.now for r in spans):
        raise ValidationError("a quoted cell is not closed: " + min(r.file for r in spans if r.now))
    started = spark.sparkContext.broadcast(frozenset((r.file, b) for r in spans for b in r.inside))
    cut = lines.mapInArrow(_cut_records(sep, started), "file string, block long, piece int, first boolean, record string")
    whole = cut.filter("piece is null").select("file", "first", "record")
    order = Window.partitionBy("file").orderBy("block", "piece")               # two pieces a split at most
    crossing = cut.filter("piece is not null").withColumn("chain", F.sum((F.col("piece") == 2).cast("int")).over(order))
    crossing = crossing.groupBy("file", "chain").agg(F.max("first").alias("first"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(crossing.select("file", "first", "record"))


# ------------------------------------------------------------------ cells
def _header(spark: SparkSession, path: str, encoding: str, sep: str, found: DataFrame | None) -> list[str]:
    """Names in the first record, cut into cells by the rule of the body."""
    if found is not None:
        row = found.filter("first").select(F.min_by("record", "file")).first()
    else:
        row = _lines(spark, path, encoding).filter((F.col("block") == 0) & (F.trim("line") != "")).select("line").first()
    line = row[0] if row is not None and row[0] is not None else ""
    return next(csv.reader(io.StringIO(line, newline=""), delimiter=sep), [])


def _cell_options(sep: str) -> dict[str, str]:
    # empty and NA-like cells stay text: the NA rule decides; a doubled quote is a quote
    return {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
            "nullValue": "\u0000__none__", "emptyValue": ""}


def read_strings(spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",",
                 multi_line: bool = False) -> DataFrame:
    """Every cell as a string (NA tokens kept as text), header names de-duplicated, plus
    the corrupt-record column for over-long rows. Cells may hold line ends; ``multi_line`` asks for Spark's
    reader of whole files instead, which does not split them."""
    found = None if multi_line else records(spark, path, encoding, sep)
    names = dedupe_header(_header(spark, path, encoding, sep, found))
    if not names:
        raise ValidationError("input has no header")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] +
                          [T.StructField(CORRUPT, T.StringType())])
    if found is not None:
        by_place = ", ".join(f"c{i} string" for i in range(len(names)))
        cells = found.filter(~F.col("first")).select(F.from_csv("record", f"{by_place}, {CORRUPT} string", _cell_options(sep)).alias("c"))
        return cells.select(*[F.col("c")[f"c{i}"].alias(n) for i, n in enumerate(names)], F.col("c")[CORRUPT].alias(CORRUPT))
    if not encoding.startswith("utf-8"):
        allow_java_charsets(spark)
    return (spark.read.schema(schema).options(**_cell_options(sep)).option("header", True).option("enforceSchema", True)
            .option("encoding", _JAVA_CHARSET[encoding]).option("multiLine", multi_line).csv(path))


def read_table(spark: SparkSession, path: str, encodings=DATASET_ENCODINGS, sep: str = ",",
               multi_line: bool = False, infer: bool = True) -> DataFrame:
    """Read a delimited text table: encoding fallback, NA tokens -> null, type inference.
    Raises ValidationError for undecodable input, an empty file, a header-only file or
    rows longer than the header."""
    enc = detect_encoding(spark, path, encodings)
    raw = read_strings(spark, path, enc, sep, multi_line)
    cols = [c for c in raw.columns if c != CORRUPT]
    cleaned = raw.select(*[na_token_to_null(F.col(q(c))).alias(c) for c in cols], F.col(CORRUPT))
    text = cleaned.drop(CORRUPT)
    # one aggregate: row count, corrupt rows and the type evidence of every column
    # Spark flags short and long rows alike; a row is too long when its raw text, parsed
    # with one spare column, fills that column (short rows are padded with nulls)
    wider = ", ".join(f"c{i} STRING" for i in range(len(cols) + 1))
    extra = F.from_csv(F.col(CORRUPT), wider, {"sep": sep, "escape": '"'})[f"c{len(cols)}"]
    row = cleaned.agg(F.count(F.lit(1)).alias("_rows"),
                      F.count_if(F.col(CORRUPT).isNotNull() & extra.isNotNull()).alias("_corrupt"),
                      *infer_aggs(text)).first()
    if row["_rows"] == 0:
        raise ValidationError("input must contain at least one data row")
    if row["_corrupt"]:
        raise ValidationError(f"{row['_corrupt']} row(s) have more fields than the header")
    if not infer:
        return text
    types = {c: type_from_counts(row[f"n{i}"], row[f"i{i}"], row[f"w{i}"], row[f"d{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}
    return apply_types(text, types)


def write_table(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Header + values, no index, UTF-8; quotes inside cells are doubled, white space stays. A directory of part
    files unless a single file is requested (which funnels the data through one task: use for small outputs only)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path
