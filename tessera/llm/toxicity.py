"""Toxic spans by a linear-chain CRF, document scores from its forward-backward marginals.

Labels are per document, so labelled tokens come first: in a bounded sample of labelled
training documents (one of each set of copies, see ``_sketch``), word and prefix features that
occur in at least ``MIN_DOCS`` and ``MIN_SHARE`` of the toxic documents with a lift of at least
``MIN_LIFT`` are kept, and a token of a toxic document
is labelled toxic when one of its features is at least ``SEED_ODDS`` times likelier in
toxic documents; all tokens of other documents are clean. The CRF is fitted to these
labels; marginals of every position of every whole text give the spans (runs of
positions at 0.5 or more) and three document figures (log-odds that any position is
toxic, expected number and expected share of toxic positions), which a logistic layer
fitted on the same sample turns into the score.

Defined results: null and empty texts have no positions, so their score is the logistic
layer's value for none; without usable labels (no toxic or no clean row) every score is
the share of toxic labels (0 without labels). Repeated rows are scored alike; a label
table that names an id twice counts as toxic if any of its rows does.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm import crf
from tessera.llm.common import chunks, fold_of, materialize, tidy, utf8

SAMPLE_PER_CLASS = 6000      # bound of the labelled sample, each class
PREFIXES = (3, 4, 5)         # in code points
MIN_DOCS, MIN_SHARE, MIN_LIFT, SEED_ODDS = 4, 0.01, 2.0, 8.0
BLOCK_BYTES = 3_000_000      # texts handled together in a task
EDGE = ".,!?;:|\"'()[]{}*#$%&<>-_"


@dataclass
class ToxicityModel:
    features: dict[str, int] = field(default_factory=dict)
    chain: crf.Chain | None = None
    layer: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    prior: float = 0.0


def token_features(word: bytes) -> tuple[str, ...]:
    """Features of a lower-cased word: itself without edge punctuation, and its prefixes."""
    w = word.decode("utf-8", "replace").strip(EDGE)
    if not w:
        return ()
    return ("=" + w, *(f"{k}{w[:k]}" for k in PREFIXES if len(w) >= k))


def _sketch(texts: pd.Series) -> pd.Series:
    """Least hash of a text's 3-word windows: copies and most near copies agree, so their
    shared rare words do not count once per copy."""
    out = []
    for t in texts:
        w = t.lower().split()
        out.append(min((zlib.crc32(b" ".join(w[i:i + 3])) << 20 | len(w[i]) for i in range(max(1, len(w) - 2))), default=0)
                   if w else 0)
    return pd.Series(out, dtype="int64")


class _Emission(dict):
    """word -> emission, filled as words turn up and emptied when it grows too large."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.f, self.w, self.b = model.features, model.chain.weights, model.chain.bias

    def __missing__(self, word: bytes) -> float:
        e = self.b
        for x in token_features(word):
            i = self.f.get(x)
            if i is not None:
                e += self.w[i]
        if len(self) > 150_000:
            self.clear()
        self[word] = e
        return e


def _log_odds(texts: list[bytes], em: _Emission, chain: crf.Chain) -> tuple[np.ndarray, np.ndarray]:
    lengths, e = [], []
    for t in texts:
        words = t.lower().split()
        lengths.append(len(words))
        e.append(np.fromiter(map(em.__getitem__, words), np.float64, len(words)))
    n = np.asarray(lengths, dtype=np.int64)
    return n, crf.marginals(n, np.concatenate(e) if e else np.zeros(0), chain)


def _figures(n: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Per document: bounded log-odds that any position is toxic, log1p of the expected
    number of toxic positions, expected share."""
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
    doc = np.repeat(np.arange(len(n)), n)
    none = -np.bincount(doc, weights=np.logaddexp(0.0, np.clip(z, -60, 60)), minlength=len(n))
    any_ = np.log(-np.expm1(np.minimum(none, -1e-12))) - none
    count = np.bincount(doc, weights=p, minlength=len(n))
    return np.stack([np.clip(any_, -8, 8), np.log1p(count), count / np.maximum(n, 1)], axis=1)


def _score(fig: np.ndarray, layer: tuple[float, ...]) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(layer[0] + fig @ np.asarray(layer[1:]), -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, train_fold=None) -> ToxicityModel:
    """Fit on the labelled rows with ``train_fold(id)`` (default: fold is not 0)."""
    keep = (train_fold or (lambda c: fold_of(c) != 0))(F.col("id"))
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
           .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & keep).groupBy("id").agg(F.max("y").alias("y")))
    shares = {r.y: r.n for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = ToxicityModel(prior=shares.get(1, 0) / max(1, sum(shares.values())))
    if not shares.get(0) or not shares.get(1):
        return model
    ids = F.broadcast(crf.bounded_sample(lab, "id", "y", per_class))       # at most 2 * per_class rows
    sample = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("t")).join(ids, "id")
    # of rows with one sketch the least (id, text) stays, whatever the partitioning
    sample = (sample.withColumn("sketch", pandas_udf(_sketch, "long")("t")).groupBy("sketch", "y")
              .agg(F.min(F.struct("id", "t")).alias("r")).select("r.id", "r.t", "y"))
    sample = materialize(sample.repartition(crf.SHARDS, "id").sortWithinPartitions("id", "t"), "toxic-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return model

    def doc_frequencies(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist()):
                seen[y].update({f for w in set(t.lower().split()) for f in token_features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()),
                                          "n0": pa.array([seen[0][x] for x in names], pa.int64()),
                                          "n1": pa.array([seen[1][x] for x in names], pa.int64())})

    # the sample bounds the features; those with support and lift are far fewer
    n0, n1 = sizes[0], sizes[1]
    odds = ((F.col("n1") + 0.5) / n1) / ((F.col("n0") + 0.5) / n0)
    found = (sample.mapInArrow(doc_frequencies, "f string, n0 long, n1 long").groupBy("f")
             .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumn("odds", odds)
             .filter((F.col("n1") >= max(MIN_DOCS, MIN_SHARE * n1)) & (F.col("odds") >= MIN_LIFT)).orderBy("f").collect())
    if not found:
        return model
    features = {r.f: i for i, r in enumerate(found)}
    seeds = {r.f for r in found if r.odds >= SEED_ODDS}

    def labelled(batches):
        for b in batches:
            rows = []
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist()):
                words = t.lower().split()
                tok, feat, lab_ = [], [], bytearray(len(words))
                for i, w in enumerate(words):
                    for f in token_features(w):
                        j = features.get(f)
                        if j is not None:
                            tok.append(i)
                            feat.append(j)
                            if y and f in seeds:
                                lab_[i] = 1
                rows.append((len(words), np.asarray(tok, np.int32).tobytes(), np.asarray(feat, np.int32).tobytes(), bytes(lab_)))
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([r[0] for r in rows], pa.int32()), "tok": pa.array([r[1] for r in rows], pa.binary()),
                "feat": pa.array([r[2] for r in rows], pa.binary()), "labels": pa.array([r[3] for r in rows], pa.binary())})

    seq = materialize(sample.mapInArrow(labelled, crf.SEQUENCE_SCHEMA), "toxic-sequences")
    start = crf.Chain(-2.0, -1.0, 0.0, 0.0, -4.0, np.asarray([0.7 * math.log(r.odds) for r in found]))
    model.features, model.chain = features, crf.fit(seq, start, positive=len(found))

    def figures(batches):
        em = _Emission(model)
        for b in batches:
            fig = _figures(*_log_odds(b.column("t").to_pylist(), em, model.chain))
            yield pa.RecordBatch.from_pydict({"y": b.column("y").cast(pa.int32()), "a": pa.array(fig[:, 0]),
                                              "b": pa.array(fig[:, 1]), "c": pa.array(fig[:, 2])})

    # one row a sampled document, at most 2 * per_class
    fig = sample.mapInArrow(figures, "y int, a double, b double, c double").toPandas()
    model.layer = _logistic(fig[["a", "b", "c"]].to_numpy(), fig["y"].to_numpy(np.float64),
                            model.prior, fig["y"].mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, share: float) -> tuple[float, ...]:
    """Newton steps with rows weighted back to the classes' true shares."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    beta = np.zeros(x1.shape[1])
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        h = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + 0.5 * np.eye(x1.shape[1])
        beta = beta + np.clip(np.linalg.solve(h, x1.T @ (w * (y - p)) - 0.5 * beta), -3, 3)
    return tuple(float(b) for b in beta)


SCORE_TYPE = "score double, n_tokens long, toxic_tokens double, spans string"


def scorer(model: ToxicityModel):
    """Column function: UTF-8 bytes -> struct(score, n_tokens, expected toxic tokens,
    spans as 'first:end' token positions, end exclusive, comma-joined)."""

    held: list[_Emission] = []               # a task's cache, kept from batch to batch

    @pandas_udf(SCORE_TYPE)
    def score(texts: pd.Series) -> pd.DataFrame:
        out = []
        if model.chain is not None and not held:
            held.append(_Emission(model))
        em = held[0] if held else None
        for part in chunks(list(texts), len, BLOCK_BYTES):
            if em is None:
                n = np.asarray([len(t.split()) for t in part], dtype=np.int64)
                out += [(model.prior, int(k), 0.0, "") for k in n]
                continue
            n, z = _log_odds(part, em, model.chain)
            s = _score(fig := _figures(n, z), model.layer)
            starts = np.concatenate([[0], np.cumsum(n)])
            spans = [""] * len(n)
            hot = np.flatnonzero(z >= 0.0)
            owner = np.searchsorted(starts, hot, side="right") - 1
            for d in np.unique(owner):
                at = hot[owner == d] - starts[d]
                cut = np.flatnonzero(np.diff(at) > 1)
                first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
                spans[d] = ",".join(f"{a}:{b + 1}" for a, b in zip(first, last))
            out += [(float(a), int(k), float(np.expm1(c)), x) for a, k, c, x in zip(s, n, fig[:, 1], spans)]
        tidy()
        return pd.DataFrame(out, columns=["score", "n_tokens", "toxic_tokens", "spans"])

    return score


def score_documents(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, toxic_tokens, spans: one row per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), scorer(model)(utf8(F.col(text_col))).alias("r"))
    return rows.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("r.score").alias("score"),
                       F.when(F.col("r.score") >= 0.5, 1).otherwise(0).alias("predicted"),
                       F.col("r.n_tokens").alias("n_tokens"), F.col("r.toxic_tokens").alias("toxic_tokens"),
                       F.col("r.spans").alias("spans"))
