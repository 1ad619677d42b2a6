"""Fill-in-middle by displacement scatter: all texts of an Arrow batch are moved at once.

A text is cut into n code points; a prefix ends after the smaller of ``h1 % (n+1)`` and
``h2 % (n+1)``, a middle after the larger (h1 to h4: the first four 8-digit groups of the
SHA-256 of ``1:`` and the id). Three layouts:

    plain  text                                         (empty texts, texts that hold a mark, and
                                                         those with h3 % 100 >= 90)
    psm    <P> prefix <S> suffix <M> middle
    spm    <S> suffix <P> prefix <M> middle             (h4 % 100 < 20)

A scan over the batch's bytes finds the code points and the byte of every cut. Each segment
moves as a whole, so a difference array (+shift where a segment starts, -shift where it ends)
and its running sum give every byte its place in the output; one numpy scatter writes them
beside the marks. ``restore`` knows output and form only: it finds the three marks (they
cannot occur in the texts, nor arise where a text meets a mark) and gathers along the inverse
shifts. Bytes are walked in windows of ``WINDOW``, so a task holds the batch and its output and
little else, however long one text is.

Defined results: null and empty texts are plain, n 0; a null id is hashed as ``1:``; rows that
repeat an id are cut at the same numbers; bytes that are no UTF-8 are kept and counted by their
lead bytes; extra columns are ignored; ``restore`` gives null where output or form is null, the
form is unknown or the marks are not those of the form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import utf8

FORMS = ("plain", "psm", "spm")
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN_FROM, SPM_BELOW = 90, 20          # of 100
WINDOW = 1 << 20


def numbers(doc_id: Column) -> list[Column]:
    """h1 to h4 of an id, as whole numbers."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and the n + 1 ends of its rows in them."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if ends else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def _column(flat: np.ndarray, ends: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    if len(flat) > 0x7FFFFFFF:
        raise ValueError("a batch's output passes 2 GB: lower spark.sql.execution.arrow.maxBytesPerBatch")
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [valid, pa.py_buffer(ends.astype(np.int32).tobytes()),
                                                              pa.py_buffer(flat)])


def _marks(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, kind) of every mark that lies within one row."""
    at = np.flatnonzero(flat == MARKS[0][0])
    at = at[at + 2 < len(flat)]
    kind = np.full(len(at), -1)
    for i, m in enumerate(MARKS):
        kind[(flat[at + 1] == m[1]) & (flat[at + 2] == m[2])] = i
    at, kind = at[kind >= 0], kind[kind >= 0]
    row = np.searchsorted(ends, at, "right") - 1
    inside = at + 2 < ends[row + 1]
    return at[inside], row[inside], kind[inside]


def code_points(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lead-byte flags (a row's first byte counts as one) and the number of them in each row."""
    lead = (flat & 0xC0) != 0x80
    some = ends[1:] > ends[:-1]
    lead[ends[:-1][some]] = True
    n = np.zeros(len(some), np.int64)
    if some.any():
        n[some] = np.add.reduceat(lead, ends[:-1][some], dtype=np.int64)
    return lead, n


def places_of(lead: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """The byte at which the code point of each (ascending) ordinal starts; past the last: the end."""
    out, seen, i = np.full(len(ordinals), len(lead), np.int64), 0, 0
    for w in range(0, len(lead), WINDOW):
        here = np.flatnonzero(lead[w:w + WINDOW])
        j = int(np.searchsorted(ordinals, seen + len(here), "left"))
        out[i:j] = w + here[ordinals[i:j] - seen]
        seen, i = seen + len(here), j
    return out


def shifts(n: int, starts: np.ndarray, stops: np.ndarray, shift: np.ndarray):
    """Windows (first byte, shift of each byte) of the running sum of the difference array that
    has ``shift`` at the starts of segments and takes it back at their stops."""
    at, change = np.concatenate([starts, stops]), np.concatenate([shift, -shift])
    order = np.argsort(at, kind="stable")
    at, change, carry = at[order], change[order], 0
    for w in range(0, n, WINDOW):
        size = min(WINDOW, n - w)
        lo, hi = np.searchsorted(at, [w, w + size])
        d = np.zeros(size, np.int64)
        np.add.at(d, at[lo:hi] - w, change[lo:hi])
        d[0] += carry
        np.cumsum(d, out=d)
        carry = int(d[-1])
        yield w, d


def scatter(flat: np.ndarray, out: np.ndarray, starts, stops, shift) -> None:
    for w, d in shifts(len(flat), starts, stops, shift):
        d += np.arange(w, w + len(d))
        out[d] = flat[w:w + len(d)]


def gather(flat: np.ndarray, out: np.ndarray, starts, stops, shift) -> None:
    for w, d in shifts(len(out), starts, stops, shift):
        d += np.arange(w, w + len(d))
        out[w:w + len(d)] = flat[d]


def _layout(form: np.ndarray, p: np.ndarray, s: np.ndarray):
    """Places within an output of prefix, middle and suffix, and of the marks <P>, <S>, <M>."""
    psm, spm = form == 1, form == 2
    prefix = np.where(psm, 3, np.where(spm, 6 + s, 0))
    suffix = np.where(psm, 6 + p, np.where(spm, 3, p))
    middle = np.where(form > 0, 9 + p + s, p)
    return prefix, middle, suffix, (prefix - 3, suffix - 3, middle - 3)


def arrange(flat: np.ndarray, ends: np.ndarray, h: list[np.ndarray]):
    """Output bytes and ends, n, form, prefix and middle length in code points."""
    lead, n = code_points(flat, ends)
    starts, stops = ends[:-1], ends[1:]
    marked = np.zeros(len(n), bool)
    marked[_marks(flat, ends)[1]] = True
    form = np.where((n == 0) | marked | (h[2] % 100 >= PLAIN_FROM), 0, np.where(h[3] % 100 < SPM_BELOW, 2, 1))
    a, b = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
    before = np.cumsum(n) - n
    cuts = places_of(lead, np.stack([before + a, before + b], 1).ravel()).reshape(-1, 2)
    # a plain text is one segment: all prefix
    cuts[form == 0] = stops[form == 0][:, None]
    cut_p, cut_m = cuts[:, 0], cuts[:, 1]
    out_ends = np.concatenate([[0], np.cumsum(stops - starts + 9 * (form > 0))])
    base = out_ends[:-1]
    prefix, middle, suffix, marks = _layout(form, cut_p - starts, stops - cut_m)
    out = np.empty(int(out_ends[-1]), np.uint8)
    scatter(flat, out, np.concatenate([starts, cut_p, cut_m]), np.concatenate([cut_p, cut_m, stops]),
            np.concatenate([base + prefix - starts, base + middle - cut_p, base + suffix - cut_m]))
    for m, at in zip(MARKS, marks):
        at = (base + at)[form > 0]
        for i, x in enumerate(m):
            out[at + i] = x
    return out, out_ends, n, form, a, b - a


def rebuild(flat: np.ndarray, ends: np.ndarray, form: np.ndarray):
    """Texts' bytes and ends from outputs and forms, and which rows could not be rebuilt."""
    k, starts, stops = len(form), ends[:-1], ends[1:]
    at, row, kind = _marks(flat, ends)
    moved = (form > 0)[row]
    at, row, kind = at[moved], row[moved], kind[moved]
    first = np.searchsorted(row, np.arange(k))
    three = (form > 0) & (np.bincount(row, minlength=k) == 3)
    place = np.zeros((k, 3), np.int64)
    order = np.zeros((k, 3), np.int64)
    for i in range(3):
        place[three, i], order[three, i] = at[first[three] + i], kind[first[three] + i]
    fits = three & (place[:, 0] == starts) & (order[:, 2] == 2) & np.where(form == 1, order[:, 0] == 0, order[:, 0] == 1) \
        & (order[:, 0] + order[:, 1] == 1)
    bad = ((form > 0) & ~fits) | (form < 0)
    one, two = place[:, 1] - place[:, 0] - 3, place[:, 2] - place[:, 1] - 3
    last = stops - place[:, 2] - 3
    whole = stops - starts
    p = np.where(fits, np.where(form == 1, one, two), np.where(bad, 0, whole))
    s = np.where(fits, np.where(form == 1, two, one), 0)
    m = np.where(fits, last, 0)
    text_ends = np.concatenate([[0], np.cumsum(p + m + s)])
    base = text_ends[:-1]
    prefix, middle, suffix, _ = _layout(np.where(fits, form, 0), p, s)
    out = np.empty(int(text_ends[-1]), np.uint8)
    gather(flat, out, np.concatenate([base, base + p, base + p + m]), np.concatenate([base + p, base + p + m, text_ends[1:]]),
           np.concatenate([starts + prefix - base, starts + middle - base - p, starts + suffix - base - p - m]))
    return out, text_ends, bad


def _transform(batches):
    for b in batches:
        flat, ends = _bytes_of(b.column(1))
        h = [b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
        out, out_ends, n, form, p, m = arrange(flat, ends, h)
        plain = form == 0
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n), pa.array(np.asarray(FORMS, object)[form], pa.string()), pa.array(p, mask=plain),
             pa.array(m, mask=plain), _column(out, out_ends)], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restore(batches):
    for b in batches:
        flat, ends = _bytes_of(b.column(1))
        out, text_ends, bad = rebuild(flat, ends, b.column(2).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([b.column(0), _column(out, text_ends, bad)], ["row", "text"])


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (UTF-8 bytes): one row per row of ``docs``."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    h = [c.alias(f"h{i}") for i, c in enumerate(numbers(F.col(id_col)))]
    rows = docs.select(F.col(id_col).alias("key"), utf8(F.col(text_col)).alias("t"), *h)
    return rows.mapInArrow(_transform, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output binary") \
        .withColumnRenamed("key", "doc_id")


def restore(rows: DataFrame, *, output_col: str = "output", form_col: str = "form", into: str = "restored") -> DataFrame:
    """``rows`` with the text rebuilt from output and form (UTF-8 bytes) as ``into``, replacing a column of that name."""
    known = F.when(F.col(output_col).isNull(), F.lit(-1))
    for i, f in enumerate(FORMS):
        known = known.when(F.col(form_col) == f, F.lit(i))
    kept = [c for c in rows.columns if c.lower() != into.lower()]
    packed = rows.select(F.struct(*kept).alias("row"), F.coalesce(F.col(output_col).cast("binary"), F.lit(b"")).alias("o"),
                         known.otherwise(F.lit(-1)).cast("long").alias("f"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_restore, f"row {kind}, text binary").select(*[F.col("row")[c].alias(c) for c in kept],
                                                                          F.col("text").alias(into))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     g AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
     s AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
                        ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
