"""Benchmark decontamination with an FM-index per shard of the corpus.

Words are runs of ASCII digits, letters (A-Z lower-cased) and code points beyond ASCII. A test item's
windows are its runs of ``WINDOW`` consecutive words; an item of fewer words is one window.

* Shards. A task numbers the words of its texts in a dictionary of the shard and cuts a shard every
  ``SHARD_WORDS`` words. Texts of a shard that are equal word by word are held once, with all their places; a
  text longer than a shard is held in pieces that overlap by ``WINDOW`` - 1 words. Each piece ends
  in a separator of its own, so every suffix is different and prefix doubling (only the suffixes still tied
  are sorted again) ends after log2 of the longest repeat. From the suffix order come the
  Burrows-Wheeler transform, held as a wavelet tree in matrix layout (a bit per word and level; ranks
  from counts per 64 bits), and the suffix positions sampled every ``SAMPLE`` words and at starts of pieces. Shards
  are a written table: they can be searched again for other test sets.
* Search. Test items are packed into blocks of ``BLOCK_WORDS`` words; a block at a time is broadcast and
  searched in every shard. All windows step backward together, a rank at both ends of their ranges
  per word; windows whose range empties leave. Equal windows have equal ranges and are located once:
  their rows walk back to sampled positions.
* Spans. Occurrences are merged into runs of words per document, and the items named.

Nothing is sampled or capped; the blocks are of a stated size and follow one another, so a test set of any size fits.

Defined results: null and empty texts and texts without words have no words and no hit; items
without words occur nowhere; rows that repeat an id or a text are rows of their own; items that repeat an id
count once, a null item id is named by the empty text; extra columns are ignored (``remove`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, materialize, tidy, utf8
from tessera.session import sql_conf

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 16
SAMPLE = 8
#: 0-9 and a-z stay, A-Z are lowered, bytes of code points beyond ASCII stay, all else separates.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
                   else 0x20 for b in range(256))
_SHARD = {"dictionary": "binary", "counts": "binary", "bits": "binary", "marks": "binary", "samples": "binary", "starts": "binary",
          "place_uid": "binary", "place_piece": "binary", "place_first": "binary"}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class _Numbers(dict):
    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


# ------------------------------------------------------------------ building
def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``t`` (whole numbers; the last one, and one in any repeat's
    continuation, is a symbol that occurs once)."""
    n, bits = len(t), max(1, int(t.max()).bit_length())
    h = max(1, 63 // bits)
    key = t.astype(np.int64)
    for i in range(1, h):
        key <<= bits
        key[:max(0, n - i)] |= t[i:]
    sa = np.argsort(key)
    key = key[sa]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    alone = first & np.concatenate([first[1:], [True]])
    tied = np.flatnonzero(~alone)
    while len(tied):
        p = sa[tied]
        key = rank[p] * n + rank[p + h]
        order = np.argsort(key)
        p, key = p[order], key[order]
        sa[tied] = p
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[p] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[~(first & np.concatenate([first[1:], [True]]))]
        h *= 2
    return sa


def wavelet_bits(symbols: np.ndarray, levels: int) -> np.ndarray:
    """Bits of the wavelet matrix, a row of 64-bit words per level (one word is spare, so that a
    rank at the end can be read)."""
    n = len(symbols)
    out = np.zeros((levels, n // 64 + 1), np.uint64)
    for row, level in enumerate(range(levels - 1, -1, -1)):
        one = (symbols >> level) & 1 == 1
        packed = np.packbits(one, bitorder="little")
        out[row].view(np.uint8)[:len(packed)] = packed
        symbols = np.concatenate([symbols[~one], symbols[one]])
    return out


def build_shard(pieces: list[np.ndarray], dictionary: list[bytes], places: list[tuple[int, int, int]]) -> dict[str, bytes]:
    """The index of pieces (word numbers); places are (uid, piece, first word in the text)."""
    d = len(pieces)
    size = np.asarray([len(p) for p in pieces], np.int64)
    t = np.empty(int(size.sum()) + d, np.int64)
    ends = np.cumsum(size + 1) - 1                      # the separators
    t[ends] = np.arange(d)
    word = np.ones(len(t), bool)
    word[ends] = False
    t[word] = np.concatenate(pieces) + d
    sa = suffix_array(t)
    before = t[sa - 1]                                  # the first suffix is preceded by the last separator
    symbols = np.maximum(before - d + 1, 0).astype(np.int32)
    del before
    sampled = (sa % SAMPLE == 0) | (symbols == 0)
    counts = np.bincount(symbols, minlength=len(dictionary) + 1)
    marks = np.zeros(len(t) // 64 + 1, np.uint64)
    packed = np.packbits(sampled, bitorder="little")
    marks.view(np.uint8)[:len(packed)] = packed
    uid, piece, first = (np.asarray(x, np.int64) for x in zip(*places))
    return {"dictionary": b" ".join(dictionary), "counts": counts.astype(np.int32).tobytes(),
            "bits": wavelet_bits(symbols, len(dictionary).bit_length()).tobytes(), "marks": marks.tobytes(),
            "samples": sa[sampled].astype(np.int32).tobytes(), "starts": (ends - size).astype(np.int32).tobytes(),
            "place_uid": uid.tobytes(), "place_piece": piece.astype(np.int32).tobytes(), "place_first": first.tobytes()}


def _build(kind: pa.DataType, window: int, shard_words: int):
    """Rows of documents and rows of shards from (uid, id, text)."""
    names = ["uid", "id", "n_words", *_SHARD]

    def batch(uid, ids, n, shard=None):
        k = 1 if shard else len(uid)
        cols = [pa.array(uid if not shard else [None], pa.int64()), ids if not shard else pa.nulls(1, kind), pa.array(n if not shard else [None], pa.int64())]
        cols += [pa.array([shard[c]], pa.binary()) if shard else pa.nulls(k, pa.binary()) for c in _SHARD]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches):
        numbers, pieces, seen, places, held = _Numbers(), [], {}, [], 0
        for b in batches:
            uids, counts = b.column(0).to_pylist(), []
            for uid, text in zip(uids, b.column(2)):
                words = words_of(text.as_py())
                n = len(words)
                counts.append(n)
                for first in range(0, max(n - window + 1, min(n, 1)), shard_words):
                    part = words if n <= shard_words else words[first:first + shard_words + window - 1]
                    ids = np.fromiter(map(numbers.__getitem__, part), np.int32, len(part))
                    key = xxhash.xxh3_128_digest(ids.tobytes())
                    if key not in seen:
                        seen[key] = len(pieces)
                        pieces.append(ids)
                        held += len(ids)
                    places.append((uid, seen[key], first))
                    if held >= shard_words or len(places) >= shard_words:
                        yield batch(None, None, None, build_shard(pieces, list(numbers), places))
                        numbers, pieces, seen, places, held = _Numbers(), [], {}, [], 0
            yield batch(uids, b.column(1), counts)
        if places:
            yield batch(None, None, None, build_shard(pieces, list(numbers), places))
        tidy()

    return run


@dataclass
class Index:
    rows: DataFrame          # uid, id, n_words
    shards: DataFrame
    window: int


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
          window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Index:
    """The written index of ``docs``. ``row_col`` names a column of row numbers if rows are to be found again."""
    from pyspark.sql.pandas.types import to_arrow_type
    uid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("t"))
    schema = f"uid long, id {rows.schema['id'].dataType.simpleString()}, n_words long, " + ", ".join(f"{c} {k}" for c, k in _SHARD.items())
    both = materialize(rows.mapInArrow(_build(to_arrow_type(rows.schema["id"].dataType), window, shard_words), schema), "fm-index")
    return Index(both.filter("uid is not null").select("uid", "id", "n_words"), both.filter("uid is null").select(*_SHARD), window)


# ------------------------------------------------------------------ searching
class Shard:
    """A shard read back: ranks, backward steps and positions, for many places at once."""

    def __init__(self, row: dict[str, bytes]):
        self.numbers = {w: i + 1 for i, w in enumerate(row["dictionary"].split(b" "))}
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.n, self.levels = int(counts.sum()), (len(counts) - 1).bit_length()
        self.bits = np.frombuffer(row["bits"], np.uint64).reshape(self.levels, -1)
        self.ones = self._counts(self.bits)
        self.zeros = self.n - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])         # where suffixes of a symbol start
        order, key = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        for level in range(self.levels):                              # symbols end up in order of their reversed bits
            key = key << 1 | (order >> level) & 1
        order = np.argsort(key, kind="stable")
        at_end = np.empty(len(counts), np.int64)
        at_end[order] = np.cumsum(counts[order]) - counts[order]
        self.to_rank = self.first[:-1] - at_end
        self.marks = np.frombuffer(row["marks"], np.uint64).reshape(1, -1)
        self.marked = self._counts(self.marks)
        self.samples = np.frombuffer(row["samples"], np.int32)
        self.starts = np.frombuffer(row["starts"], np.int32).astype(np.int64)
        self.places = tuple(np.frombuffer(row[c], k) for c, k in (("place_uid", np.int64), ("place_piece", np.int32), ("place_first", np.int64)))

    @staticmethod
    def _counts(bits: np.ndarray) -> np.ndarray:
        c = np.cumsum(np.bitwise_count(bits), 1, dtype=np.int32)
        return np.concatenate([np.zeros((len(bits), 1), np.int32), c[:, :-1]], 1)

    @staticmethod
    def _rank(bits, ones, i):
        w, low = i >> 6, (i & 63).astype(np.uint64)
        below = bits[w] & ((np.uint64(1) << low) - np.uint64(1))
        return ones[w].astype(np.int64) + np.bitwise_count(below)

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that put ``symbol`` before the first i suffixes' ends of a range."""
        for row in range(self.levels):
            r = self._rank(self.bits[row], self.ones[row], i)
            i = np.where((symbol >> (self.levels - 1 - row)) & 1, self.zeros[row] + r, i - r)
        return self.to_rank[symbol] + i

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer, for each row."""
        symbol = np.zeros(len(i), np.int64)
        for row in range(self.levels):
            bit = (self.bits[row][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            r = self._rank(self.bits[row], self.ones[row], i)
            i, symbol = np.where(bit, self.zeros[row] + r, i - r), symbol << 1 | bit
        return self.to_rank[symbol] + i

    def find(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the windows words[start : start + length]; 0 is no word of the shard."""
        lo, hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        for k in range(int(length.max(initial=0))):
            live = live[length[live] > k]
            c = words[start[live] + length[live] - 1 - k]
            live, c = live[c > 0], c[c > 0]
            a, b = (self.first[c], self.first[c + 1]) if k == 0 else (self.step(c, lo[live]), self.step(c, hi[live]))
            keep = a < b
            live = live[keep]
            now_lo, now_hi = np.zeros_like(lo), np.zeros_like(hi)     # windows that left have an empty range
            done = length <= k
            now_lo[done], now_hi[done] = lo[done], hi[done]
            now_lo[live], now_hi[live] = a[keep], b[keep]
            lo, hi = now_lo, now_hi
        return lo, hi

    def positions(self, i: np.ndarray) -> np.ndarray:
        """Where the suffixes of rows start."""
        out, walked, live = np.zeros(len(i), np.int64), 0, np.arange(len(i))
        while len(live):
            here = (self.marks[0][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[live[here]] = self.samples[self._rank(self.marks[0], self.marked[0], i[here])] + walked
            live, i, walked = live[~here], self.back(i[~here]), walked + 1
        return out


class Phrases:
    """A block of test items: their words end to end, and every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.words = [w for _, ws in items for w in ws]
        size = np.asarray([len(ws) for _, ws in items], np.int64)
        windows = np.where(size == 0, 0, np.maximum(size - window + 1, 1))
        base = np.repeat(np.cumsum(size) - size, windows)
        within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start, self.length = base + within, np.repeat(np.minimum(size, window), windows)
        self.item = np.repeat(np.asarray([number[name] for name, _ in items], np.int64), windows)


def _runs(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], cover.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def occurrences(shard: Shard, phrases: Phrases):
    """Per piece of the shard with a hit: piece, runs of hit words (first, end), numbers of its items."""
    words = np.fromiter((shard.numbers.get(w, 0) for w in phrases.words), np.int64, len(phrases.words))
    lo, hi = shard.find(words, phrases.start, phrases.length)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return
    kind, of = np.unique(np.stack([lo[hit], hi[hit], phrases.length[hit]]), axis=1, return_inverse=True)
    of = of.ravel()
    n = kind[1] - kind[0]                                          # equal windows are located once
    which = np.repeat(np.arange(len(n)), n)
    at = shard.positions(kind[0][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    change = np.zeros(shard.n + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + kind[2][which], -1)
    first, end = _runs(np.cumsum(change[:-1]) > 0)
    run_piece = np.searchsorted(shard.starts, first, "right") - 1
    # items of a piece: those of the windows that occur in it
    piece_kind = np.unique(np.stack([np.searchsorted(shard.starts, at, "right") - 1, which]), axis=1)
    kind_item = np.unique(np.stack([of, phrases.item[hit]]), axis=1)
    from_, to = np.searchsorted(kind_item[0], piece_kind[1], "left"), np.searchsorted(kind_item[0], piece_kind[1], "right")
    for piece in np.unique(run_piece).tolist():
        a, b = np.searchsorted(run_piece, [piece, piece + 1])
        p, q = np.searchsorted(piece_kind[0], [piece, piece + 1])
        items = np.unique(np.concatenate([kind_item[1][x:y] for x, y in zip(from_[p:q], to[p:q])]))
        yield piece, first[a:b] - shard.starts[piece], end[a:b] - shard.starts[piece], items


def _search(phrases):
    names = ["uid", "spans", "items"]
    span = pa.struct([("first", pa.int64()), ("end", pa.int64())])

    def run(batches):
        block = phrases.value
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({c: b.column(k)[i].as_py() for k, c in enumerate(_SHARD)})
                uid, piece, offset = shard.places
                order = np.argsort(piece, kind="stable")
                uid, piece, offset = uid[order], piece[order], offset[order]
                found = ((p, first, end, [block.names[x] for x in items]) for p, first, end, items in occurrences(shard, block))
                rows = ((int(uid[j]), [{"first": int(x + offset[j]), "end": int(y + offset[j])} for x, y in zip(first, end)], items)
                        for p, first, end, items in found for j in range(*np.searchsorted(piece, [p, p + 1])))
                for part in chunks(rows, lambda r: 1 + len(r[1]) + len(r[2]), 50_000):
                    u, s, t = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(s, pa.list_(span)), pa.array(t, pa.list_(pa.string()))], names)
        tidy()

    return run


def _packed(window: int):
    """Items packed into rows of about BLOCK_WORDS words; a longer one is cut into overlapping parts."""
    def parts(batches):
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(text.as_py())
                for first in range(0, max(len(words) - window + 1, min(len(words), 1)), BLOCK_WORDS):
                    yield name, words if len(words) <= BLOCK_WORDS else words[first:first + BLOCK_WORDS + window - 1]

    def run(batches):
        for part in chunks(parts(batches), lambda x: len(x[1]), BLOCK_WORDS):
            yield pa.RecordBatch.from_arrays([pa.array([[n for n, _ in part]], pa.list_(pa.string())),
                                              pa.array([[b" ".join(w) for _, w in part]], pa.list_(pa.binary()))], ["names", "texts"])

    return run


def hits(index: Index, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """uid, spans (runs of words, may overlap), items (ids as text, may repeat) of every row with a hit."""
    spark = index.shards.sparkSession
    name = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    packed = materialize(items.select(name.alias("n"), utf8(F.col(text_col)).alias("t")).mapInArrow(
        _packed(index.window), "names array<string>, texts array<binary>"), "fm-items")
    rows = ((n, t.split()) for r in packed.toLocalIterator() for n, t in zip(r.names, map(bytes, r.texts)))
    schema = "uid long, spans array<struct<first: long, end: long>>, items array<string>"
    found = []
    # the reader of the shards, whose rows are megabytes, takes a few at a time
    with sql_conf(spark, spark__sql__parquet__columnarReaderBatchSize="8", spark__sql__execution__arrow__maxRecordsPerBatch="8"):
        for block in chunks(rows, lambda x: len(x[1]), BLOCK_WORDS):
            phrases = spark.sparkContext.broadcast(Phrases(block, index.window))
            found.append(materialize(index.shards.mapInArrow(_search(phrases), schema), "fm-hits"))
    out = found[0] if found else spark.createDataFrame([], schema)
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def _hit_words(spans):
    """Words covered by any span."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(spans), start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["end"]).alias("end")), lambda acc: acc["n"])


def report(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: one row per row of ``docs``."""
    index = build(docs, id_col=id_col, text_col=text_col, window=window, shard_words=shard_words)
    found = hits(index, items)
    names = F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))))
    covered = F.coalesce(_hit_words(F.col("spans")), F.lit(0).cast("long"))
    return index.rows.join(found, "uid", "left").select(
        F.col("id").alias("doc_id"), "n_words", covered.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (covered > 0).alias("contaminated"), "spans")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    word = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    first, end = _runs(word)
    keep = np.ones(len(text), bool)
    for a, b in spans:
        keep[first[a]:end[b - 1]] = False
    # neighbouring and overlapping spans leave nothing between them
    return np.frombuffer(text, np.uint8)[keep].tobytes()


def _cut(batches):
    for b in batches:
        spans = b.column(2).to_pylist()
        out = [t.as_py() if s is None else cut(t.as_py(), [(x["first"], x["end"]) for x in s]) for t, s in zip(b.column(1), spans)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["uid", "t"])


def remove(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit span cut out of the text; rows without a hit stay as they are."""
    taken = {c.lower() for c in docs.columns}
    uid, other = [n for n in (f"row_{i}" for i in range(len(taken) + 2)) if n not in taken][:2]
    numbered = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "fm-rows")
    found = materialize(hits(build(numbered, id_col=id_col, text_col=text_col, row_col=uid, window=window), items), "fm-found")
    texts = numbered.select(F.col(uid).alias("uid"), utf8(F.col(text_col)).alias("t")).join(found.select("uid", "spans"), "uid")
    texts = texts.mapInArrow(_cut, "uid long, t binary").select(F.col("uid").alias(uid), F.col("t").cast("string").alias(other))
    return numbered.join(texts, uid, "left").withColumn(text_col, F.coalesce(other, text_col)).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     q AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM (
               SELECT item, w, least(len(w), 10) AS k, unnest(range(0, greatest(len(w) - 9, least(len(w), 1)))) AS i FROM b)),
     p AS (SELECT uid, k, i, array_to_string(w[i + 1:i + k], ' ') AS s FROM (
               SELECT uid, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
     o AS (SELECT p.uid, p.i, p.k, q.item FROM p JOIN q ON p.k = q.k AND p.s = q.s),
     h AS (SELECT uid, count(DISTINCT j) AS n_hit FROM (SELECT uid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT uid, i, k FROM o)) GROUP BY uid),
     t AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT uid, item FROM o) GROUP BY uid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (uid) LEFT JOIN t USING (uid)"""
