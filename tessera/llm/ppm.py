"""Language-model scoring by prediction by partial matching over bytes.

The model is a context trie (order 2 unless a longer one is asked for) over lower-cased UTF-8 bytes: every training text,
with two boundary bytes before and one after it (0xFF never occurs in UTF-8), adds one
count to each (context, next byte) of orders 0, 1 and 2. A byte is predicted in the
longest context that was seen; symbols not seen there escape to the next shorter one
(method C: escapes weigh as much as the number of distinct symbols), where symbols already
excluded by the longer context no longer take part; below order 0 the rest of the 256
symbols share evenly. A document's score is the sum of log10 probabilities of its bytes
and of its end.

Training counts are gathered from all training texts: tasks count trigrams of bytes,
Spark adds them, and the probabilities below each last context byte are worked out
group by group. At order 2 the trie has at most 2^24 entries whatever the corpus, so a
table of costs is what each scoring task holds. Bytes that no training text holds share their costs,
so the table has a row for each byte that occurs and one for all others (at most 64 MB).

Longer orders (``order`` 3 to 6; ``ORDER`` in the query) follow the same rules. Their contexts grow with the
corpus and stay in Spark: tasks count the longest grams, shorter ones (trigrams too) are sums of them, and every
context is a row with its symbols' counts and the mass of those symbols one order below (which
exclusion takes away there). Texts are scored in chunks of about ``CHUNK_BYTES``; a chunk asks for its distinct contexts
by a join, and meets the answers in one task, where orders 0 to 2 come from the table and each distinct gram
of the chunk is costed once.

The base model counts words (one end token per text). Words that make up at least one in
``HEAVY`` training tokens are at most that many and are broadcast; all rarer words are
looked up by a join.

Defined results: null texts count as empty and have one token, the end; without training
rows N = V = 0 and every byte costs log10(256); rows that repeat an id are scored
separately and alike.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, chunks, fold_of, materialize, tidy, utf8

BOUND = b"\xff"
N_KEYS = 1 << 24
BLOCK_BYTES = 4_000_000
LONG_BLOCK_BYTES = 1_000_000 # text whose longer grams a task sorts at once
ORDER = 4                    # order of the query's model
CHUNK_BYTES = 16_000_000     # text that asks for its contexts together
FLUSH_GRAMS = 2_000_000      # distinct long grams a counting task holds
HEAVY = 1_000_000            # at most so many words are broadcast
HEAVY_BYTES = 64             # longer words always go through the join
FLUSH_WORDS = 300_000        # distinct words a counting task holds
IS_SPACE = np.isin(np.arange(256), list(SPACE))


def byte_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram keys (two context bytes, next byte) of all texts, and each text's first
    key. The two positions that only open a text have key -1."""
    a = np.frombuffer(b"".join(BOUND * 2 + t + BOUND for t in texts), np.uint8).astype(np.int32)
    lengths = np.asarray([len(t) + 3 for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    key = np.empty(len(a), np.int32)
    key[2:] = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    key[starts] = -1
    key[starts + 1] = -1
    return key, starts


def add_counts(key: np.ndarray, total: np.ndarray) -> None:
    """Add the keys' counts to ``total`` (one entry per possible key; untouched pages of it
    take no memory). Bytes are numbered by those that occur, which keeps the counting array small."""
    key = key[key >= 0]
    if not len(key):
        return
    used = np.flatnonzero(np.bincount(key & 255, minlength=256) + np.bincount((key >> 8) & 255, minlength=256)
                          + np.bincount(key >> 16, minlength=256))
    rank, m = np.zeros(256, np.int32), len(used)
    rank[used] = np.arange(m)
    n = np.bincount((rank[key >> 16] * m + rank[(key >> 8) & 255]) * m + rank[key & 255], minlength=m ** 3)
    at = np.flatnonzero(n)
    total[(used[at // (m * m)] << 16) | (used[at // m % m] << 8) | used[at % m]] += n[at]


def tokens(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts end to end, each text's followed by its end (the empty word), and each text's first one."""
    a = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = IS_SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))            # a word starts, it ends, the next one starts
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    count = np.diff(np.searchsorted(starts, bounds)) + 1
    first = np.cumsum(count) - count
    offsets = np.zeros(len(starts) + len(texts) + 1, np.int32)
    word = np.ones(len(offsets) - 1, bool)
    word[first + count - 1] = False
    offsets[1:][word] = ends - starts
    np.cumsum(offsets, out=offsets)
    return pa.BinaryArray.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(a[~space])]), first


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order (for many copies a plain sort beats ``np.unique``)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def long_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``order`` context bytes and the next byte at every byte and end of the texts, and
    each text's first one."""
    a = np.frombuffer(b"".join(BOUND * order + t + BOUND for t in texts), np.uint8)
    key = np.zeros(len(a) - order, np.int64)
    for i in range(order + 1):
        key = (key << 8) | a[i:len(a) - order + i]
    lengths = np.asarray([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    return key[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(texts)) * order, lengths)], starts


def _count_long(order: int):
    def run(batches):
        held, total = [], 0

        def rows():
            g, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([y for _, y in held])).astype(np.int64)
            return g, n

        def out(g, n):
            for i in range(0, len(g), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[i:i + 500_000]), pa.array(n[i:i + 500_000])], ["gram", "n"])

        for b in batches:
            for part in chunks((x.as_py() for x in b.column(0)), len, LONG_BLOCK_BYTES):
                held.append(np.unique(long_keys([t.lower() for t in part], order)[0], return_counts=True))
                total += len(held[-1][0])
                if total > FLUSH_GRAMS:
                    held = [rows()]
                    total = len(held[0][0])
                    if 2 * total > FLUSH_GRAMS:
                        yield from out(*held[0])
                        held, total = [], 0
        if held:
            yield from out(*rows())
        held.clear()
        tidy()

    return run


def _long_grams(docs: DataFrame, order: int) -> DataFrame:
    """gram, n: ``order`` context bytes and the next byte."""
    return materialize(docs.mapInArrow(_count_long(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams", "zstd")


def _contexts(grams: DataFrame, order: int) -> DataFrame:
    """k, ctx, total, below, symbols, counts: every context of orders 3 to ``order``; ``below`` is what its
    symbols weigh in the context one byte shorter. Groups have at most 256 rows."""
    out = None
    for k in range(order, 2, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        both = grams.withColumn("low", low).withColumn("n_low", F.sum("n").over(Window.partitionBy("low")))
        rows = both.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(
            F.sum("n").alias("total"), F.sum("n_low").alias("below"),
            F.array_sort(F.collect_list(F.struct(F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("s"), "n"))).alias("x"))
        rows = rows.select(F.lit(k).alias("k"), "ctx", "total", "below", F.col("x.s").alias("symbols"), F.col("x.n").alias("counts"))
        out = rows if out is None else out.unionByName(rows)
        grams = grams.groupBy(low.alias("gram")).agg(F.sum("n").alias("n"))
    return materialize(out, "ppm-contexts", "zstd")


def _packed(rows: list[tuple]) -> tuple:
    """(ids, uids, lengths, compressed texts) of rows (id, uid, text)."""
    ids, uids, texts = zip(*rows)
    return list(ids), list(uids), [len(t) for t in texts], pa.compress(b"".join(texts), "zstd", asbytes=True)


def _unpacked(lengths: list[int], packed: bytes) -> list[bytes]:
    held = pa.decompress(packed, sum(lengths), "zstd", asbytes=True) if any(lengths) else b""
    ends = np.cumsum([0, *lengths]).tolist()
    return [held[a:z] for a, z in zip(ends, ends[1:])]


def _ask_contexts(order: int):
    """Rows (chunk, ids, uids, lengths, texts) of consecutive texts and, at the end of a chunk, (chunk, k, ctx) of its
    distinct contexts."""
    names = ["chunk", "ids", "uids", "lengths", "t", "k", "ctx"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int64()]

    def run(batches):
        chunk, size, asked = None, 0, []

        def asks():
            c = distinct(np.concatenate(asked))
            for k in range(order, 2, -1):
                for i in range(0, len(c), 500_000):
                    part = c[i:i + 500_000]
                    none = [pa.nulls(len(part), t) for t in types[1:5]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk, np.int64)), *none,
                                                      pa.array(np.full(len(part), k, np.int32)), pa.array(part)], names)
                c = distinct(c & ((1 << 8 * (k - 1)) - 1))

        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(3)))
            for part in chunks(rows, lambda r: len(r[2]), LONG_BLOCK_BYTES):
                part = [(i, u, t.lower()) for i, u, t in part]
                if chunk is None:
                    chunk = part[0][1]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((chunk, *_packed(part), None, None), types)], names)
                asked.append(distinct(long_keys([t for _, _, t in part], order)[0] >> 8))
                size += sum(len(t) for _, _, t in part)
                if size >= CHUNK_BYTES:
                    yield from asks()
                    chunk, size, asked = None, 0, []
        if asked:
            yield from asks()
        tidy()

    return run


def _at(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted ``table`` the values are, and whether they are there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a column's lists, and their values end to end."""
    parts = [c for c in column.chunks if len(c)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate([np.diff(c.offsets.to_numpy()) for c in parts]).astype(np.int64),
            np.concatenate([c.flatten().to_numpy() for c in parts]))


class Table:
    """The costs of order 2: log10 probabilities by trigram key. ``logp`` holds all keys, only those of bytes that occur are kept."""

    def __init__(self, logp: np.ndarray, seen: np.ndarray):
        used = np.flatnonzero(seen)
        other = np.flatnonzero(~seen)[:1]
        kept = np.concatenate([used, other])
        self.rank, self.m = np.full(256, len(used), np.int32), len(kept)
        self.rank[used] = np.arange(len(used))
        self.logp = np.ascontiguousarray(logp.reshape(256, 256, 256)[np.ix_(kept, kept, kept)]).reshape(-1)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        r, m = self.rank, self.m
        return self.logp[(r[(key >> 16) & 255] * m + r[(key >> 8) & 255]) * m + r[key & 255]].astype(np.float64)


class _Long:
    """The contexts one chunk asked for, by order."""

    def __init__(self, found: pa.Table, order: int):
        self.levels = []
        for k in range(order, 2, -1):
            part = found.filter(pc.equal(found.column("k"), k)).select(["ctx", "total", "below", "symbols", "counts"])
            ctx = part.column("ctx").to_numpy()
            by = np.argsort(ctx, kind="stable")
            d, symbols = _lists(part.column("symbols"))
            n = _lists(part.column("counts"))[1]
            first = np.cumsum(d) - d
            at = np.repeat(first[by] - (np.cumsum(d[by]) - d[by]), d[by]) + np.arange(len(symbols))
            ctx, d = ctx[by], d[by]
            self.levels.append((k, ctx, part.column("total").to_numpy()[by].astype(np.float64), part.column("below").to_numpy()[by].astype(np.float64),
                                d.astype(np.float64), (np.repeat(ctx, d) << 8) | symbols[at], n[at]))

    def costs(self, u: np.ndarray, logp: Table, total2: np.ndarray, kinds2: np.ndarray, seen2: np.ndarray) -> np.ndarray:
        """log10 probabilities of the grams ``u``."""
        reach, cost, done = np.zeros(len(u)), np.zeros(len(u)), np.zeros(len(u), bool)
        mass, kinds = np.zeros(len(u)), np.zeros(len(u))           # of excluded symbols, at the order looked at
        for k, ctx, total, below, d, grams, n in self.levels:
            at, has = _at(ctx, (u >> 8) & ((1 << 8 * k) - 1))
            if not has.any():
                continue
            spot, hit = _at(grams, u & ((1 << 8 * (k + 1)) - 1))
            new = np.where(has, d[at] - kinds, 0)
            whole = np.where(new > 0, total[at] - mass + new, 1)
            take = hit & ~done
            cost[take] = reach[take] + np.log10(n[spot[take]] / whole[take])
            done |= hit
            reach = reach + np.where(new > 0, np.log10(np.where(new > 0, new, 1) / whole), 0)
            mass, kinds = np.where(has, below[at], 0), np.where(has, d[at], 0)
        key = u & (N_KEYS - 1)
        c, p = key >> 8, logp[key]
        seen = (seen2[key >> 3] >> (7 - (key & 7)).astype(np.uint8)) & 1 == 1
        # the table's costs are those without exclusion by longer contexts
        d2 = np.where(kinds2[c] == 256, 0, kinds2[c])
        full = np.where(total2[c] > 0, total2[c] + d2, 1)
        new = kinds2[c] - kinds
        rest = np.where(new > 0, total2[c] - mass + np.where(d2 > 0, new, 0), 1)
        escape = np.where(new > 0, np.log10(np.where(new > 0, new, 1) / rest), 0) - np.log10(np.where(d2 > 0, d2, 1) / full)
        p = np.where(kinds > 0, np.where(seen, p + np.log10(full / rest), p + escape), p)
        return np.where(done, cost, reach + p)


def _long_scores(order: int, table, base):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        long, logp, low = _Long(found, order), table.value, base.value
        del found
        scores, uids = [], []
        grams, costs = np.zeros(0, np.int64), np.zeros(0)          # the chunk's grams so far, in order, and what they cost
        for i in range(docs.num_rows):
            uids += docs.column("uids")[i].as_py()
            part = _unpacked(docs.column("lengths")[i].as_py(), docs.column("t")[i].as_py())
            key, starts = long_keys(part, order)
            coded = pc.dictionary_encode(pa.array(key))
            u = coded.dictionary.to_numpy()
            by = np.argsort(u)
            new = u[by][~_at(grams, u[by])[1]]
            spot = np.searchsorted(grams, new)
            grams, costs = np.insert(grams, spot, new), np.insert(costs, spot, long.costs(new, logp, *low))
            cost = np.empty(len(u))
            cost[by] = costs[_at(grams, u[by])[0]]
            scores += np.add.reduceat(cost[coded.indices.to_numpy()], starts).tolist()
        tidy()
        return pa.table({"uid": pa.array(uids, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def _count_corpus(order: int):
    """Partition-wise counts: rows (null, word, n) and, for order 2, (gram, null, n)."""
    def run(batches):
        grams = np.zeros(N_KEYS if order == 2 else 0, np.int64)
        held, total = [], 0

        def sums():
            added = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"word": added.column("word"), "n": added.column("n_sum")})

        def out(words):
            for b in words.to_batches(200_000):
                yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int32()), b.column("word"), b.column("n")], ["gram", "word", "n"])

        for b in batches:
            for part in chunks(b.column(0).to_pylist(), len, BLOCK_BYTES):
                part = [t.lower() for t in part]
                if order == 2:
                    add_counts(byte_keys(part)[0], grams)
                found = pc.value_counts(tokens(part)[0])
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                total += len(found)
                if total > 2 * FLUSH_WORDS:
                    held = [sums()]
                    total = held[0].num_rows
                    if total > FLUSH_WORDS:
                        yield from out(held[0])
                        held, total = [], 0
        if held:
            yield from out(sums())
        held.clear()
        at = np.flatnonzero(grams)
        for i in range(0, len(at), 500_000):
            k = at[i:i + 500_000]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(k.astype(np.int32)), "word": pa.nulls(len(k), pa.binary()),
                                              "n": pa.array(grams[k])})
        del grams
        tidy()

    return run


def costs_below(last: int | None, c2: np.ndarray, c0: np.ndarray) -> np.ndarray:
    """log10 probabilities [older byte, symbol] for contexts that end in ``last``; c2: their
    counts [older byte, symbol]; c0: counts of order 0. PPM with method C and exclusion."""
    c1 = c2.sum(axis=0)
    logp = np.full((256, 256), np.nan)
    reach = np.zeros((256, 1))                           # log10 of the escapes so far
    gone = np.zeros((256, 256), bool)                    # symbols of longer contexts
    for level in (c2, np.broadcast_to(c1, (256, 256)), np.broadcast_to(c0, (256, 256))):
        c = np.where(gone, 0, level).astype(np.float64)
        seen = c > 0
        n, d = c.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        gone = gone | seen
        d = np.where(gone.all(axis=1, keepdims=True), 0, d)      # nothing left to escape to
        with np.errstate(divide="ignore", invalid="ignore"):
            logp = np.where(seen, reach + np.log10(c) - np.log10(n + d), logp)
            reach = reach + np.where(n > 0, np.log10(np.where(d > 0, d, 1)) - np.log10(np.where(n > 0, n + d, 1)), 0.0)
    rest = (~gone).sum(axis=1, keepdims=True)
    return np.where(gone, logp, reach - np.log10(np.maximum(rest, 1))).astype(np.float32)


class PpmModel:
    """log10 probability per trigram key, and the base model's word counts."""

    def __init__(self, logp: Table, words: DataFrame, n: int, v: int, heavy: dict[bytes, int],
                 order: int = 2, contexts: DataFrame | None = None, base: tuple = ()):
        self.logp, self.words, self.n, self.v, self.heavy = logp, words, n, v, heavy
        self.order, self.contexts, self.base = order, contexts, base      # base: totals, kinds and seen bits of order 2


def fit(docs: DataFrame, train: Column, *, text_col: str = "text", order: int = 2) -> PpmModel:
    """Gather the model from all rows of ``docs`` where ``train`` holds."""
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    texts = docs.filter(train).select(utf8(F.col(text_col)).alias("t"))
    counts = materialize(texts.mapInArrow(_count_corpus(order), "gram int, word binary, n long"), "ppm-counts")
    long = _long_grams(texts, order) if order > 2 else None
    # a longer gram ends in the trigram at the same place, so their sums are the trigrams' counts
    parts = counts.filter("gram is not null") if long is None else long.select(F.col("gram").bitwiseAND(F.lit(N_KEYS - 1)).cast("int").alias("gram"), "n")
    grams = parts.groupBy("gram").agg(F.sum("n").alias("n"))
    sym = F.col("gram").bitwiseAND(255)
    c0 = np.zeros(256)
    for r in parts.groupBy(sym.alias("s")).agg(F.sum("n").alias("n")).collect():   # 256 rows
        c0[r.s] = r.n

    def table_of(rows: pd.DataFrame) -> pd.DataFrame:
        g = rows["gram"].to_numpy()
        last = int(g[0] >> 8) & 255
        c2 = np.zeros((256, 256))
        c2[g >> 16, g & 255] = rows["n"].to_numpy()
        return pd.DataFrame({"last": [last], "p": [costs_below(last, c2, c0).tobytes()], "total": [c2.sum(axis=1).tobytes()],
                             "seen": [np.packbits(c2 > 0).tobytes()]})

    logp = np.empty((256, 256, 256), np.float32)
    logp[:] = costs_below(None, np.zeros((256, 256)), c0)[:, None, :]          # last byte never seen
    below = F.shiftright("gram", 8).bitwiseAND(255)
    total2, seen2 = np.zeros((256, 256)), np.zeros((256, 256, 32), np.uint8)
    for r in grams.groupBy(below).applyInPandas(table_of, "last int, p binary, total binary, seen binary").collect():       # at most 66 MB
        logp[:, r["last"], :] = np.frombuffer(r.p, np.float32).reshape(256, 256)
        total2[:, r["last"]] = np.frombuffer(r.total, np.float64)
        seen2[:, r["last"], :] = np.frombuffer(r.seen, np.uint8).reshape(256, 32)
    kinds2 = np.unpackbits(seen2, axis=2).sum(axis=2).astype(np.float64)
    contexts = _contexts(long, order) if order > 2 else None

    words = materialize(counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "ppm-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    often = words.filter((F.col("c") * HEAVY >= F.lit(total.n)) & (F.length("word") <= HEAVY_BYTES)).collect()  # at most HEAVY
    return PpmModel(Table(logp, c0 > 0), words, total.n, total.v, {bytes(r.word): r.c for r in often}, order, contexts,
                    (total2.reshape(-1), kinds2.reshape(-1), seen2.reshape(-1)))


def score_documents(docs: DataFrame, model: PpmModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    spark = docs.sparkSession
    spread = model.n + 0.5 * (model.v + 1)
    table = spark.sparkContext.broadcast(model.logp)                           # at most 64 MB, whatever the corpus
    heavy = spark.sparkContext.broadcast({w: math.log10((c + 0.5) / spread) for w, c in model.heavy.items()})
    model_order = model.order
    fields = "doc_id long, uid long, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>"

    def plain(batches):
        for b in batches:
            yield b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()

    def unpacked(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, uids, lengths, packed = (b.column(j)[i].as_py() for j in range(4))
                yield ids, uids, _unpacked(lengths, packed)

    def score(batches):
        logp, get = table.value, heavy.value.get
        for ids, uids, whole in (plain if model_order == 2 else unpacked)(batches):
            at = 0
            for part in chunks(whole, len, BLOCK_BYTES):
                part = [t.lower() for t in part]
                total = np.zeros(len(part))
                if model_order == 2:
                    key, starts = byte_keys(part)
                    cost = logp[key]
                    cost[key < 0] = 0.0
                    total = np.add.reduceat(cost, starts)
                words, first = tokens(part)
                coded = words.dictionary_encode()
                code, names = coded.indices.to_numpy(), coded.dictionary
                x = np.asarray(list(map(get, names.to_numpy(zero_copy_only=False))), dtype=np.float64)[code]
                miss = np.isnan(x)
                n = np.diff(np.append(first, len(x)))
                # the rare words of each text, each once
                rare, times = np.unique(np.repeat(np.arange(len(part)), n)[miss] * len(names) + code[miss], return_counts=True)
                ends = pa.array(np.searchsorted(rare, np.arange(len(part) + 1) * len(names)), pa.int32())
                cols = (pa.array(ids[at:at + len(part)], pa.int64()), pa.array(uids[at:at + len(part)], pa.int64()), pa.array(n, pa.int64()),
                        pa.array(n - np.add.reduceat(miss.astype(np.int64), first), pa.int64()),
                        pa.array(np.add.reduceat(np.where(miss, 0.0, x), first)), pa.array(total, pa.float64()),
                        pa.ListArray.from_arrays(ends, names.take(pa.array(rare % len(names)))),
                        pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())))
                yield pa.RecordBatch.from_arrays(list(cols), ["doc_id", "uid", "n_tokens", "n_known", "base", "score", "rare", "times"])
                at += len(part)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), utf8(F.col(text_col)).alias("t"))
    if model.order > 2:
        chunked = materialize(texts.mapInArrow(_ask_contexts(model.order), "chunk long, ids array<long>, uids array<long>, lengths array<long>, t binary, k int, ctx long"), "ppm-chunks", "zstd")
        texts = chunked.filter("k is null").select("chunk", "ids", "uids", "lengths", "t")
        found = chunked.filter("k is not null").select(F.col("chunk").alias("asker"), "k", "ctx").join(model.contexts, ["k", "ctx"])
        base = spark.sparkContext.broadcast(model.base)                        # 3 MB
        long = materialize(texts.drop("ids").groupBy("chunk").cogroup(found.groupBy("asker")).applyInArrow(
            _long_scores(model.order, table, base), "uid long, score double"), "ppm-long")
        texts = texts.drop("chunk")
    first = materialize(texts.mapInArrow(score, fields), "ppm-scored")
    rare = first.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "uid", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    first = first.drop("rare", "times")
    if model.order > 2:
        first = first.drop("score").join(long, "uid")
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (rare.join(model.words, "word", "left").groupBy("uid")
            .agg(F.sum(F.col("k") * F.log10((c + 0.5) / F.lit(float(spread)))).alias("base2"),
                 F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known2")))
    return first.join(rest, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), "score")


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id) == 1
