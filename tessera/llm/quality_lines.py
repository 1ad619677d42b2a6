"""Quality by line sequence labelling: a linear-chain CRF marks each line as content or
boilerplate by Viterbi decoding, and the share of words in content lines decides.

Training lines come from a bounded sample of documents with a quality label: in rows of
low quality every line is boilerplate; in the others a line that repeats an earlier one
is boilerplate and every other line is content. The CRF's features are discretised
properties of a line (``line_features``), so the model has a fixed small size.

Base figures are counted over whole texts: words ``[^\\x20\\x09-\\x0D]+``, code points in
words, characters of ``[#*$%&|<>]``, repeated lines (\\n-split, with a word, equal to an
earlier line), words inside 3-word windows that occur twice or more.

Defined results: null and empty texts have no words and fail the base rule; without
usable labels no line is marked, and the base rule alone decides; repeated rows get
equal results; ties in Viterbi go to content.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm import crf
from tessera.llm.common import SPACE, chunks, materialize, tidy, utf8

SAMPLE_PER_CLASS = 4000      # bound of the labelled sample, each class
CONTENT_SHARE = 0.5          # least share of words in content lines
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
BLOCK_BYTES = 4_000_000

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_CLAUSE = b".,;:?"
N_BUCKETS = 6
# groups of N_BUCKETS features each, then single flags
GROUPS = ("words", "word_length", "upper", "symbols", "pipes", "bangs", "digits", "distinct", "clauses")
FLAGS = ("repeat", "ends_sentence", "first", "last")
N_FEATURES = len(GROUPS) * N_BUCKETS + len(FLAGS)


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    for i, e in enumerate(edges):
        if x <= e:
            return i
    return len(edges)


_COUNT = (2, 5, 12, 40, 150)
_LENGTH = (2.5, 4.0, 6.0, 9.0, 14.0)
_SHARE = (0.0, 0.01, 0.05, 0.15, 0.4)
_WIDE = (0.3, 0.5, 0.7, 0.85, 0.95)


def line_features(line: bytes, words: list[bytes], repeat: bool, first: bool, last: bool) -> list[int]:
    """Active features of a line that has a word."""
    n, size = len(words), len(line)
    ink = max(1, size - (size - len(line.translate(None, SPACE))))
    gone = lambda chars: size - len(line.translate(None, chars))
    values = ((n, _COUNT), (ink / n, _LENGTH), (gone(_UPPER) / ink, _SHARE), (gone(SYMBOLS) / ink, _SHARE),
              (line.count(b"|") / n, _SHARE), (line.count(b"!") / n, _SHARE), (gone(_DIGITS) / ink, _SHARE),
              (len(set(words)) / n, _WIDE), (gone(_CLAUSE) / n, _SHARE))
    out = [g * N_BUCKETS + _bucket(v, edges) for g, (v, edges) in enumerate(values)]
    flags = (repeat, line.rstrip(SPACE)[-1:] in (b".", b"?", b":"), first, last)
    base = len(GROUPS) * N_BUCKETS
    return out + [base + i for i, f in enumerate(flags) if f]


def lines_of(text: bytes) -> tuple[list[tuple[list[int], int, bool]], int]:
    """Per line with a word: (features, words, repeat of an earlier line); repeats."""
    kept, seen, repeats = [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            kept.append((line, words, again))
    end = len(kept) - 1
    return [(line_features(x, w, r, i == 0, i == end), len(w), r) for i, (x, w, r) in enumerate(kept)], repeats


def repeated_words(ids: np.ndarray, n_ids: int) -> int:
    """Words inside 3-word windows that occur twice or more (first occurrence included)."""
    if len(ids) < 4:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if n_ids < 1 << 21:
        key = (a << 42) | (b << 21) | c
    else:                                      # too many words to pack three: number the pairs first
        key = (np.unique((a << 32) | b, return_inverse=True)[1].astype(np.int64) << 32) | c
    order = np.argsort(key, kind="stable")
    same = key[order]
    same = same[1:] == same[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(ids), dtype=bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


@dataclass
class LineModel:
    chain: crf.Chain | None = None


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> LineModel:
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
           .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y")))
    ids = F.broadcast(crf.bounded_sample(lab, "id", "y", per_class))       # at most 2 * per_class rows
    sample = (docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("t"))
              .join(ids, "id").repartition(crf.SHARDS, "id"))

    def labelled(batches):
        for b in batches:
            rows = []
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist()):
                lines, _ = lines_of(t)
                tok = np.repeat(np.arange(len(lines), dtype=np.int32), [len(f) for f, _, _ in lines])
                feat = np.asarray([f for fs, _, _ in lines for f in fs], dtype=np.int32)
                rows.append((len(lines), tok.astype(np.int32).tobytes(), feat.tobytes(),
                             bytes(int(y == 0 or r) for _, _, r in lines)))
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([r[0] for r in rows], pa.int32()), "tok": pa.array([r[1] for r in rows], pa.binary()),
                "feat": pa.array([r[2] for r in rows], pa.binary()), "labels": pa.array([r[3] for r in rows], pa.binary())})

    seq = materialize(sample.mapInArrow(labelled, crf.SEQUENCE_SCHEMA), "line-sequences")
    # bytes 0 and 1 of the labels tell whether both kinds of line are there
    kinds = seq.filter("n > 0").agg(
        F.max(F.instr(F.hex("labels"), "01") > 0).alias("bad"), F.max(F.instr(F.hex("labels"), "00") > 0).alias("good")).first()
    if not (kinds.bad and kinds.good):
        return LineModel()
    start = crf.Chain(0.0, -1.0, 0.0, 1.0, -1.0, np.zeros(N_FEATURES))
    return LineModel(crf.fit(seq, start, iterations=15, step=0.3, l2=1.0))


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, content_words long, boilerplate string")


def marker(model: LineModel):
    """Column function: UTF-8 bytes -> struct of RESULT; boilerplate lists the marked
    lines' numbers among the lines with a word."""

    @pandas_udf(RESULT)
    def mark(texts: pd.Series) -> pd.DataFrame:
        out, vocab = [], {}
        for part in chunks(list(texts), len, BLOCK_BYTES):
            base, lengths, tok, feat, sizes = [], [], [], [], []
            for t in part:
                words = t.split()
                if len(vocab) > 300_000:
                    vocab.clear()
                ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int64, len(words))
                lines, repeats = lines_of(t)
                code_points = len(t) - len(t.translate(None, _TAILS)) if _TAILS else 0
                base.append((len(words), len(t.translate(None, SPACE)) - code_points,
                             len(t) - len(t.translate(None, SYMBOLS)), repeats, repeated_words(ids, len(vocab))))
                at = len(sizes)
                for i, (fs, n, _) in enumerate(lines):
                    tok += [at + i] * len(fs)
                    feat += fs
                    sizes.append(n)
                lengths.append(len(lines))
            n = np.asarray(lengths, dtype=np.int64)
            if model.chain is None:
                y = np.zeros(len(sizes), dtype=bool)
            else:
                y = crf.viterbi(n, crf.emissions(len(sizes), np.asarray(tok, np.int64), np.asarray(feat, np.int64), model.chain),
                                model.chain)
            at = 0
            for b, k in zip(base, lengths):
                bad, words = y[at:at + k], np.asarray(sizes[at:at + k])
                out.append((*b, k, int(words[~bad].sum()) if k else 0, ",".join(map(str, np.flatnonzero(bad)))))
                at += k
        vocab.clear()
        tidy()
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return mark


_TAILS = bytes(range(0x80, 0xC0))            # UTF-8 continuation bytes: not a code point of their own


def judge(docs: DataFrame, model: LineModel, *, id_col: str = "doc_id", text_col: str = "text",
          content_share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, and the method's own figures."""
    rows = docs.select(F.col(id_col).alias("doc_id"), marker(model)(utf8(F.col(text_col))).alias("r")).select("doc_id", "r.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = F.col("content_words") / F.greatest(F.col("n_words"), F.lit(1))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & (share >= F.lit(content_share))).alias("kept"),
                       share.alias("content_share"), "n_lines", "boilerplate")
