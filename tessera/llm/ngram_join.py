"""Exact similarity self-join of documents on word shingles with a token-group matrix.

A document's set holds the 64-bit hashes of its distinct k-word shingles (words
``[^\\x20\\x09-\\x0D]+`` lower-cased A-Z; with fewer words the whole sequence is one). Equal sets
are one class from the start, so copies never meet each other.

1. One pass makes a row per document (class, size) and counts frequent shingles; those in at least ``FREQUENT`` texts of a task's block, at most
   ``MAX_FREQUENT`` in all, only order the shingles: rare ones first, then by hash. The order is the
   same for all documents, so the prefix rule holds: two sets that reach the threshold share at
   least l of their first n - ceil(t n) + l shingles, for any l; l grows with the set (``least_shared``).
2. Prefixes go through one shuffle; shingles in two classes or more stay. Only classes with
   l such shingles (l of the smallest set that could link with them) can have a partner; the others leave,
   and with them shingles that are then in one class only. The remaining classes' whole sets are read from the texts again.
3. Similar classes are grouped: a class votes, shingle by shingle, for the class of least hash
   that shares the shingle, and joins the group of the one it names most often; then the groups vote in
   the same way, until none joins another (at most ``VOTES`` times; groups decide where work is done, not what is found).
   Groups are cut by hash into blocks of about ``GROUP_TOKENS`` shingles. Within a block every class is counted against all
   members through the block's postings, and a forest of links is kept.
   A group of several blocks is folded further: one class per component stands for it, and these meet
   in blocks of their own, as long as that at least halves them. Each round is linear in what is left.
4. Of two blocks the members of one query the other. Blocks of one group are asked by every class of the group
   that they may hold a partner of (another component, a size within the threshold): a row per class and block, as
   nearly all shingles of such blocks are shared. Other blocks are asked by the matrix (shingle, block) over the
   members' prefixes: a class asks a block where l of its prefix shingles are held by members of other
   groups. Which (component, block) pairs there are is found per shingle before any row of a class
   is made, and shingles of one group ask nothing. One class per component asks first; what it
   links is folded into the components before all others ask. A block opens only if the overlap of the query
   with its token union reaches what the threshold asks for, and its members are then counted exactly. Queries
   of a block are cut by hash into parts of about ``GROUP_TOKENS`` shingles, each with a copy of the members.
   A query gets one link per component, and no link between components is lost.
5. Components of all links give each document the smallest id it reaches.

Defined results: null and empty texts and texts without words have n_shingles 0 and are
alone; rows that repeat an id or a text are rows of their own and meet in their class; null
ids are never a component's name unless all ids in it are null; extra columns are ignored.
Hashes: two different shingles agree with probability 2^-64.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, materialize, tidy, utf8
from tessera.llm.components import connected_components
from tessera.session import sql_conf

SHINGLE, PERCENT = 4, 85
FREQUENT = 3                 # texts of a block that make a shingle frequent
MAX_FREQUENT = 1 << 20       # frequent shingles that order the prefix (8 MB)
GROUP_TOKENS = 1 << 19
BLOCK_BYTES = 4_000_000
SMALL_ROWS = 1_000_000       # tables of two or three numbers a row are broadcast up to so many rows
VOTES = 6
L_STEP = 25                  # one more shared prefix shingle is asked for per so many shingles
_MULT = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """word -> 64-bit hash, emptied when it grows too large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, k: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = min(k, len(w))
    with np.errstate(over="ignore"):
        s = np.full(len(w) - n + 1, np.uint64(n))
        for i in range(n):
            s = _mixed((s * _MULT) + h[i:len(w) - n + 1 + i])
    return np.unique(s)


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s) & 0xFFFFFFFF) - (1 << 63)


def least_shared(n):
    """l of a set of n shingles (works on numbers and columns of whole numbers)."""
    return n // L_STEP + 1


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + least_shared(n)


def _least_shared(n: Column) -> Column:
    return F.floor(n / F.lit(L_STEP)).cast("long") + 1


def _partner_least(n: Column, percent: int) -> Column:
    """l of the smallest set that can link with one of n shingles."""
    return _least_shared(F.ceil(n * F.lit(percent) / F.lit(100)))


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _signatures(k: int):
    names = ["uid", "id", "n", "cls", "token", "count"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        words = _Words()
        for b in batches:
            rows, at = [], 0
            uid, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in chunks(b.column(2).to_pylist(), len, BLOCK_BYTES):
                sets, seen = [], set()
                for t in part:
                    s = shingle_set(t, k, words)
                    c = class_of(s) if len(s) else None
                    rows.append((uid[at], ids[at], len(s), c, None, None))
                    at += 1
                    if c is not None and c not in seen:
                        seen.add(c)
                        sets.append(s)
                if sets:
                    v = np.sort(np.concatenate(sets))
                    cut = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                    n = np.diff(np.concatenate([cut, [len(v)]]))
                    often = n >= FREQUENT
                    rows += [(None, None, None, None, int(x), int(m))
                             for x, m in zip(v[cut][often].astype(np.int64), n[often])]
            yield _batch(rows, names, types)
        words.clear()
        tidy()

    return run


def _prefixes(k: int, percent: int, frequent):
    def run(batches):
        words, often, seen = _Words(), frequent.value, set()
        for b in batches:
            tokens, owners = [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, k, words)
                if not len(s):
                    continue
                c = class_of(s)
                if c in seen:                       # copies in this task: once
                    continue
                seen.add(c)
                p = first_tokens(s, often, percent)
                tokens.append(p)
                owners.append(np.full(len(p), c, np.int64))
            if len(seen) > 2_000_000:
                seen.clear()
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)),
                                                  pa.array(np.concatenate(owners))], ["token", "cls"])
        words.clear()
        tidy()

    return run


def first_tokens(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set: rare shingles first, then frequent ones, each by hash."""
    p = prefix_length(len(s), percent)
    if not len(often):
        return s[:p]
    at = np.searchsorted(often, s)
    at[at == len(often)] = len(often) - 1
    hit = often[at] == s
    rare = s[~hit]
    return rare[:p] if len(rare) >= p else np.concatenate([rare, s[hit][:p - len(rare)]])


def _sets(k: int):
    def run(batches):
        words = _Words()
        for b in batches:
            sets = [s for s in (shingle_set(t, k, words) for t in b.column(0).to_pylist()) if len(s)]
            yield _batch([(class_of(s), len(s), s.tobytes()) for s in sets], ["cls", "n", "tokens"],
                         [pa.int64(), pa.int32(), pa.binary()])
        words.clear()
        tidy()

    return run


class _Postings:
    """A block's members: which of them hold each of a query's shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.asarray([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def linked_members(self, s: np.ndarray, percent: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        hit = hi > lo
        # the overlap with the token union bounds the overlap with every member
        if 100 * int(hit.sum()) < percent * len(s):
            return np.zeros(0, np.int64)
        lo, n = lo[hit], (hi - lo)[hit]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(s) - common))


def _sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _links(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in rows], pa.int64()), "b": pa.array([y for _, y in rows], pa.int64())})


def _link_block(percent: int):
    """A block's members: a forest of links with the components of all its links."""
    def run(members: pa.Table) -> pa.Table:
        names, sets = members.column("cls").to_pylist(), _sets_of(members.column("tokens"))
        parent, out = list(range(len(sets))), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        post, left = _Postings(sets), len(sets)
        for i, s in enumerate(sets):
            for j in post.linked_members(s, percent).tolist():
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((names[i], names[j]))
                    left -= 1
            if left == 1:
                break
        return _links(out)

    return run


def _open_block(percent: int):
    """Cogroup of a block's members and a part of its queries: one link per query and component."""
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        names, comps = members.column("cls").to_pylist(), members.column("comp").to_pylist()
        out = []
        if names and queries.num_rows:
            post = _Postings(_sets_of(members.column("tokens")))
            for q, own, s in zip(queries.column("q").to_pylist(), queries.column("q_comp").to_pylist(), _sets_of(queries.column("q_tokens"))):
                seen = {own}
                for j in post.linked_members(s, percent).tolist():
                    if comps[j] not in seen:
                        seen.add(comps[j])
                        out.append((q, names[j]))
        return _links(out)

    return run


def _in_two_classes(marks: DataFrame) -> DataFrame:
    """(token, cls) rows whose token is in two classes or more."""
    ends = marks.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    return marks.join(ends.filter("lo <> hi").select("token"), "token")


def _links_inside(sets: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Links within each ``grp`` of ``member`` (cls, grp)."""
    crowded = member.groupBy("grp").agg(F.count("*").alias("k")).filter("k > 1").select("grp")
    inside = sets.select("cls", "tokens").join(_small(materialize(member.join(crowded, "grp").select("cls", "grp"), "sim-inside")), "cls")
    return materialize(inside.groupBy("grp").applyInArrow(_link_block(percent), "a long, b long"), "sim-inner")


def _with_comp(member: DataFrame, links: DataFrame) -> DataFrame:
    comps = connected_components(links).withColumnRenamed("node", "cls")
    return materialize(member.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "sim-members")


def _representatives(member: DataFrame, *keys: str) -> DataFrame:
    """One class (cls, n) per ``keys``: that of least hash."""
    return member.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("cls").alias("o"), "cls", "n")).alias("r")).select(*keys, "r.cls", "r.n")


def _fold_groups(sets: DataFrame, member: DataFrame, links: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members with ``comp``, links) after one class per component of a group with several
    blocks met the others of its group, while each round halves them."""
    named, before, turn = _with_comp(member, links), None, 1
    while True:
        reps = materialize(_representatives(named.filter("blocks > 1"), "top", "comp"), "sim-reps")
        left = reps.count()
        if left == 0 or (before is not None and 2 * left > before):
            return named, links
        cut = reps.groupBy("top").agg(F.ceil(F.sum("n") / F.lit(GROUP_TOKENS)).cast("long").alias("parts"))
        turn += 1
        placed = reps.join(cut, "top").select("cls", F.xxhash64("top", F.pmod(F.xxhash64(F.lit(turn), "cls"), "parts")).alias("grp"))
        links = materialize(links.unionByName(_links_inside(sets, placed, percent)), "sim-links")
        named, before = _with_comp(member, links), left


def _settled_groups(shared: DataFrame) -> DataFrame:
    """cls, top: the group of every class of ``shared`` (token, cls). From the second vote on, only shingles that
    several groups hold are looked at; the others are a number per group, votes for itself."""
    of = materialize(shared.select("cls", F.col("cls").alias("top")).distinct(), "sim-tops")
    marks, own = shared.select("token", F.col("cls").alias("top"), F.lit(1).cast("long").alias("w")), None
    for _ in range(VOTES):
        heads = marks.groupBy("token").agg(F.min(F.struct(F.xxhash64("top").alias("o"), "top")).alias("h"))
        votes = marks.join(heads, "token").select("top", F.col("h.top").alias("head"), "w")
        if own is not None:
            votes = votes.unionByName(own.select("top", F.col("top").alias("head"), "w"))
        votes = votes.groupBy("top", "head").agg(F.sum("w").alias("votes"))
        to = materialize(votes.groupBy("top").agg(F.max(F.struct("votes", "head")).alias("v")).select("top", F.col("v.head").alias("head")), "sim-heads")
        moved = to.filter("head <> top").count()
        if not moved:
            break
        while moved:                                # a head's hash is less than that of the group that names it: no circles
            on = to.select(F.col("top").alias("head"), F.col("head").alias("next"))
            both = materialize(to.join(_small(on), "head").select("top", "head", "next"), "sim-heads")
            moved = both.filter("next <> head").count()
            to = both.select("top", F.col("next").alias("head"))
        to = _small(materialize(to, "sim-heads"))
        of = materialize(of.join(to, "top").select("cls", F.col("head").alias("top")), "sim-tops")
        marks = materialize(marks.join(to, "top").groupBy("token", F.col("head").alias("top")).agg(F.sum("w").alias("w")), "sim-votes")
        ends = materialize(marks.groupBy("token").agg(F.min("top").alias("lo"), F.max("top").alias("hi"), F.sum("w").alias("w")), "sim-ends")
        alone = ends.filter("lo = hi").select(F.col("lo").alias("top"), "w")
        if own is not None:
            alone = alone.unionByName(own.join(to, "top").select(F.col("head").alias("top"), "w"))
        own = materialize(alone.groupBy("top").agg(F.sum("w").alias("w")), "sim-own")
        marks = marks.join(ends.filter("lo <> hi").select("token"), "token")
    return of


def _asks(shared: DataFrame, member: DataFrame, asking: DataFrame | None, percent: int) -> DataFrame:
    """cls, n, comp, grp, part: which class (of ``asking``, else of all) queries which block."""
    asker = member if asking is None else member.join(asking.select("cls"), "cls")
    other = (F.col("c_lo") != F.col("comp")) | (F.col("c_hi") != F.col("comp"))
    sized = (100 * F.col("n") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("n"))
    ends = (F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    # blocks of the class's own group: a row for each group of several blocks and block of it
    near = materialize(member.filter("blocks > 1").groupBy("top", "grp").agg(*ends), "sim-blocks")
    within = asker.filter("blocks > 1").withColumnRenamed("grp", "own").join(_small(near), "top") \
        .filter((F.col("own") < F.col("grp")) & other & sized).select("cls", "n", "comp", "grp")
    # blocks of other groups, by the shingles that several groups hold
    marks = shared.join(member.select("cls", "n", "top", "grp", "comp"), "cls")
    tops = marks.groupBy("token").agg(F.min("top").alias("t_lo"), F.max("top").alias("t_hi")).filter("t_lo <> t_hi").select("token")
    marks = materialize(marks.join(tops, "token"), "sim-marks")
    matrix = marks.groupBy("token", "grp").agg(F.first("top").alias("at"), *ends)
    if asking is not None:
        marks = marks.join(asking.select("cls"), "cls")
    own = marks.withColumnRenamed("grp", "own")
    pairs = (own.groupBy("token", "comp", "top").agg(F.min("own").alias("first")).join(matrix, "token")
             .filter((F.col("at") != F.col("top")) & (F.col("first") < F.col("grp")) & other)
             .select("token", "comp", "top", "grp", "lo", "hi"))
    rows = own.join(pairs, ["token", "comp", "top"]).filter((F.col("own") < F.col("grp")) & sized)
    least = F.least(_least_shared(F.max("n")), _least_shared(F.min("lo")))
    between = rows.groupBy("cls", "n", "comp", "grp").agg(F.count("*").alias("k"), least.alias("least")) \
        .filter(F.col("k") >= F.col("least")).select("cls", "n", "comp", "grp")
    asks = materialize(within.unionByName(between), "sim-asks")
    parts = asks.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(GROUP_TOKENS)).cast("long").alias("parts"))
    return materialize(asks.join(parts, "grp").select(
        "cls", "n", "comp", "grp", "parts", F.pmod(F.xxhash64(F.lit(2), "cls"), "parts").alias("part")), "sim-queries")


def _links_between(shared: DataFrame, sets: DataFrame, member: DataFrame, asking: DataFrame | None, percent: int) -> DataFrame:
    asks = _asks(shared, member, asking, percent)
    asked = sets.select(F.col("cls").alias("q"), F.col("tokens").alias("q_tokens"))
    queries = asked.join(_small(asks.select(F.col("cls").alias("q"), F.col("comp").alias("q_comp"), F.col("grp").alias("q_grp"),
                                            F.col("part").alias("q_part"))), "q")
    # a part that no query fell into needs no copy of the members
    opened = materialize(member.select("cls", "comp", "grp").join(asks.select("grp", "part").distinct(), "grp"), "sim-opened")
    inside = sets.select("cls", "tokens").join(_small(opened), "cls")
    return materialize(inside.groupBy("grp", "part").cogroup(queries.groupBy("q_grp", "q_part")).applyInArrow(
        _open_block(percent), "a long, b long"), "sim-outer")


@dataclass
class Joined:
    rows: DataFrame          # uid, id, n, cls
    classes: DataFrame       # cls, id (smallest), n
    members: DataFrame       # cls, comp (class id) for classes with a link


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast a materialised table of a few numbers a row if it is small, else leave the
    join to a shuffle."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def similarity_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                          shingle: int = SHINGLE, percent: int = PERCENT, row_col: str | None = None) -> Joined:
    """``row_col`` names a column of row numbers if rows are to be found again; see ``join``."""
    spark = docs.sparkSession
    with sql_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        return _similarity_components(docs, id_col, text_col, shingle, percent, row_col)


def _similarity_components(docs, id_col, text_col, shingle, percent, row_col) -> Joined:
    spark = docs.sparkSession
    uid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = utf8(F.col(text_col)).alias("t")
    first = materialize(docs.select(uid.alias("uid"), F.col(id_col).cast("long").alias("id"), text).mapInArrow(
        _signatures(shingle), "uid long, id long, n int, cls long, token long, count long"), "sim-signatures")
    rows = first.filter("token is null").select("uid", "id", "n", "cls")
    # the most frequent shingles, at most MAX_FREQUENT: they order prefixes and decide nothing
    often = (first.filter("token is not null").groupBy("token").agg(F.sum("count").alias("c"))
             .orderBy(F.desc("c"), "token").limit(MAX_FREQUENT).select("token"))
    often = np.asarray([r.token for r in often.collect()], np.int64).astype(np.uint64)
    frequent = spark.sparkContext.broadcast(np.sort(often))
    classes = materialize(rows.filter("n > 0").groupBy("cls").agg(
        F.min("id").alias("id"), F.first("n").alias("n")), "sim-classes")

    prefixes = docs.select(text).mapInArrow(_prefixes(shingle, percent, frequent), "token long, cls long")
    prefixes = materialize(prefixes, "sim-prefixes")          # read twice: the texts are not cut into shingles again
    shared = materialize(_in_two_classes(prefixes).distinct(), "sim-shared")
    sizes = classes.select("cls", "n")
    for _ in range(2):
        needed = materialize(shared.groupBy("cls").agg(F.count("*").alias("k")).join(sizes, "cls").filter(
            F.col("k") >= _partner_least(F.col("n"), percent)).select("cls"), "sim-needed")
        shared = materialize(_in_two_classes(shared.join(_small(needed), "cls").select("token", "cls")), "sim-shared")
    needed = materialize(shared.select("cls").distinct(), "sim-needed")
    wanted = materialize(classes.join(needed, "cls").select(F.col("id").alias("wanted_id")).distinct(), "sim-wanted")
    full = docs.select(F.col(id_col).cast("long").alias("i"), text).join(
        _small(wanted), F.col("i").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = materialize(full.select("t").mapInArrow(_sets(shingle), "cls long, n int, tokens binary"), "sim-sets")
    found = sets.agg(F.count("*").alias("rows"), F.count_distinct("cls").alias("classes")).first()
    if found.rows > found.classes:               # rows that repeat an id came along: one set a class
        sets = materialize(sets.groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sim-sets")

    # groups of similar classes, cut into blocks
    member = _settled_groups(shared).join(sets.select("cls", "n"), "cls")
    blocks = member.groupBy("top").agg(F.ceil(F.sum("n") / F.lit(GROUP_TOKENS)).cast("long").alias("blocks"))
    member = materialize(member.join(blocks, "top").select(
        "cls", "n", "top", "blocks", F.xxhash64("top", F.pmod(F.xxhash64(F.lit(1), "cls"), "blocks")).alias("grp")), "sim-members")

    named, links = _fold_groups(sets, member, _links_inside(sets, member, percent), percent)

    # the matrix: one class of each component asks first, then all whose component is still not the block's
    crowd = named.groupBy("comp").agg(F.count_distinct("grp").alias("k")).filter("k > 1").select("comp")
    first = materialize(_representatives(named.join(crowd, "comp"), "comp"), "sim-first")
    if first.count():
        links = materialize(links.unionByName(_links_between(shared, sets, named, first, percent)), "sim-links")
        named = _with_comp(member, links)
    outer = _links_between(shared, sets, named, None, percent)
    return Joined(rows, classes, materialize(connected_components(links.unionByName(outer)), "sim-components"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
         percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size: one row per row of ``docs``."""
    return _with_components(similarity_components(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent))\
        .select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                F.coalesce("component_id", "id").alias("component_id"), "class_size")


def _with_components(j: Joined) -> DataFrame:
    """Every row with its component's smallest id and its class's size."""
    sizes = j.rows.filter("n > 0").groupBy("cls").agg(F.count("*").alias("class_size"))
    c = (j.classes.select("cls", "id").join(sizes, "cls").join(j.members.withColumnRenamed("node", "cls"), "cls", "left")
         .withColumn("comp", F.coalesce("comp", "cls")))
    names = c.groupBy("comp").agg(F.min("id").alias("component_id"))
    c = c.join(names, "comp").select("cls", "component_id", "class_size")
    return j.rows.select("uid", "id", "n", "cls").join(c, "cls", "left")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                     percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component (smallest id, then first row); rows without
    words all stay. All columns are kept."""
    taken = {c.lower() for c in docs.columns}
    uid = next(n for n in ("uid", *(f"row_{i}" for i in range(len(taken) + 1))) if n not in taken)
    numbered = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "sim-rows")
    rows = similarity_components(numbered, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent, row_col=uid)
    named = rows.rows.select("uid", "id", "n", "cls").join(rows.members.withColumnRenamed("node", "cls"), "cls", "left") \
        .filter("n > 0").withColumn("comp", F.coalesce("comp", "cls"))
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "uid")).alias("w"))
    lost = (named.join(best, "comp").filter(F.col("uid") != F.col("w.uid")).select(F.col("uid").alias(uid)))
    return numbered.join(lost, uid, "left_anti").drop(uid)
