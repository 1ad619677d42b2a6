"""A two-state linear-chain conditional random field, vectorised over many sequences.

With two states only the log-odds of state 1 against state 0 matter, so the forward,
backward and Viterbi recursions are one number per position. Sequences of a block are
laid out time-major (longest first), and each step handles all sequences still running.

Training is a Spark job per iteration: tasks hold shards of the (bounded) training
sample, return the gradient of their shard, and the driver adds at most ``SHARDS``
vectors of the model's size and takes a sign-adaptive step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 12
N_CHAIN = 4            # start, enter (0 to 1), leave (1 to 0), stay (1 to 1); 0 to 0 is 0


@dataclass
class Chain:
    """start, enter, leave, stay: chain weights; weights: one per feature (state 1)."""
    start: float
    enter: float
    leave: float
    stay: float
    bias: float
    weights: np.ndarray

    def vector(self) -> np.ndarray:
        return np.concatenate([[self.start, self.enter, self.leave, self.stay, self.bias], self.weights])

    @staticmethod
    def of(v: np.ndarray) -> "Chain":
        return Chain(*(float(x) for x in v[:5]), np.asarray(v[5:], dtype=np.float64))


class Layout:
    """Time-major positions of sequences with the given lengths."""

    def __init__(self, lengths: np.ndarray):
        n = np.asarray(lengths, dtype=np.int64)
        order = np.argsort(-n, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(n))
        longest = int(n.max()) if len(n) else 0
        counts = np.bincount(n, minlength=longest + 1)
        self.active = len(n) - np.cumsum(counts)[:longest]      # sequences longer than t
        self.off = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])[:-1]
        t = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(starts, n)
        self.place = self.off[t] + np.repeat(rank, n)           # doc-major to time-major
        self.steps = longest

    def packed(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), dtype=x.dtype)
        out[self.place] = x
        return out


def _forward(lay: Layout, e: np.ndarray, m: Chain) -> np.ndarray:
    r = np.empty_like(e)
    for t in range(lay.steps):
        a, k = lay.off[t], lay.active[t]
        now = e[a:a + k]
        if t == 0:
            r[a:a + k] = m.start + now
        else:
            p = r[lay.off[t - 1]:lay.off[t - 1] + k]
            r[a:a + k] = now + np.logaddexp(p + m.stay, m.enter) - np.logaddexp(p + m.leave, 0.0)
    return r


def _backward(lay: Layout, e: np.ndarray, m: Chain) -> np.ndarray:
    b = np.zeros_like(e)
    for t in range(lay.steps - 2, -1, -1):
        a, k = lay.off[t], lay.active[t + 1]
        n = lay.off[t + 1]
        x = e[n:n + k] + b[n:n + k]
        b[a:a + k] = np.logaddexp(m.stay + x, m.leave) - np.logaddexp(m.enter + x, 0.0)
    return b


def marginals(lengths: np.ndarray, emission: np.ndarray, m: Chain) -> np.ndarray:
    """Log-odds of state 1 at every position (sequences one after another)."""
    if not len(emission):
        return np.zeros(0)
    lay = Layout(lengths)
    e = lay.packed(np.asarray(emission, dtype=np.float64))
    return (_forward(lay, e, m) + _backward(lay, e, m))[lay.place]


def viterbi(lengths: np.ndarray, emission: np.ndarray, m: Chain) -> np.ndarray:
    """Best state sequence; ties go to state 0."""
    if not len(emission):
        return np.zeros(0, dtype=bool)
    lay = Layout(lengths)
    e = lay.packed(np.asarray(emission, dtype=np.float64))
    d = np.empty_like(e)
    from1 = np.zeros(len(e), dtype=bool)     # best predecessor if this state is 1
    from0 = np.zeros(len(e), dtype=bool)     # best predecessor if this state is 0
    for t in range(lay.steps):
        a, k = lay.off[t], lay.active[t]
        if t == 0:
            d[a:a + k] = m.start + e[a:a + k]
            continue
        p = d[lay.off[t - 1]:lay.off[t - 1] + k]
        in1, in0 = p + m.stay, p + m.leave
        from1[a:a + k], from0[a:a + k] = in1 > m.enter, in0 > 0.0
        d[a:a + k] = e[a:a + k] + np.maximum(in1, m.enter) - np.maximum(in0, 0.0)
    y = np.zeros(len(e), dtype=bool)
    for t in range(lay.steps - 1, -1, -1):
        a, k = lay.off[t], lay.active[t]
        nxt = lay.active[t + 1] if t + 1 < lay.steps else 0
        y[a + nxt:a + k] = d[a + nxt:a + k] > 0.0
        if nxt:
            n = lay.off[t + 1]
            y[a:a + nxt] = np.where(y[n:n + nxt], from1[n:n + nxt], from0[n:n + nxt])
    return y[lay.place]


def emissions(n: int, tok: np.ndarray, feat: np.ndarray, m: Chain) -> np.ndarray:
    """bias + sum of the weights of each position's features."""
    return m.bias + np.bincount(tok, weights=m.weights[feat], minlength=n)


def gradient(lengths, tok, feat, labels, m: Chain) -> np.ndarray:
    """Observed minus expected counts (of the log-likelihood) and nothing else."""
    n = len(labels)
    lay = Layout(lengths)
    e = lay.packed(emissions(n, tok, feat, m))
    r, b = _forward(lay, e, m), _backward(lay, e, m)
    p1 = 1.0 / (1.0 + np.exp(-np.clip((r + b)[lay.place], -500, 500)))
    y = labels.astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    starts = starts[np.asarray(lengths) > 0]
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    here = np.flatnonzero(~first)            # positions with a predecessor
    rp, x = r[lay.place][here - 1], (e + b)[lay.place][here]
    w = np.stack([m.enter + x, rp + m.leave, rp + m.stay + x, np.zeros_like(x)])
    w = np.exp(w - w.max(axis=0))
    w = (w / w.sum(axis=0)).sum(axis=1)
    a, z = y[here - 1], y[here]
    res = y - p1
    return np.concatenate([
        [res[starts].sum(), ((1 - a) * z).sum() - w[0], (a * (1 - z)).sum() - w[1], (a * z).sum() - w[2], res.sum()],
        np.bincount(feat, weights=res[tok], minlength=len(m.weights))])


SEQUENCE_SCHEMA = "n int, tok binary, feat binary, labels binary"


def fit(sequences: DataFrame, start: Chain, iterations: int = 12, l2: float = 0.05,
        step: float = 0.5, positive: int = 0) -> Chain:
    """Maximise the penalised likelihood over ``sequences`` (rows of SEQUENCE_SCHEMA:
    position count, int32 position and feature of each feature occurrence, byte labels).
    ``sequences`` must be the bounded, materialised training sample.
    ``positive``: so many leading feature weights are kept at 0 or more."""
    v = start.vector()
    delta, before = np.full(len(v), step), np.zeros(len(v))
    # dealt and ordered by content, so sums do not depend on how the sample came to be read
    key = F.xxhash64(*sequences.columns)
    shards = sequences.repartition(SHARDS, key).sortWithinPartitions(key)
    for _ in range(iterations):
        total = _sum_gradients(shards, v)
        if total is None:
            break
        g = total - l2 * v
        same = np.sign(g) * np.sign(before)
        delta = np.clip(np.where(same > 0, delta * 1.3, np.where(same < 0, delta * 0.5, delta)), 1e-4, 2.0)
        v = v + np.sign(g) * delta
        if positive:
            v[5:5 + positive] = np.maximum(v[5:5 + positive], 0.0)
        before = g
    return Chain.of(v)


def _sum_gradients(shards: DataFrame, v: np.ndarray) -> np.ndarray | None:
    packed = v.tobytes()

    def run(batches):
        m, total = Chain.of(np.frombuffer(packed)), None
        for batch in batches:
            n = np.asarray(batch.column(0).to_pylist(), dtype=np.int64)
            if not n.sum():
                continue
            base = np.concatenate([[0], np.cumsum(n)])[:-1]
            tok = [np.frombuffer(x, np.int32) + o for x, o in zip(batch.column(1).to_pylist(), base)]
            feat = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            lab = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
            g = gradient(n, np.concatenate(tok), np.concatenate(feat), lab, m)
            total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    rows = shards.mapInArrow(run, "g binary").collect()     # at most SHARDS rows
    return sum(np.frombuffer(r.g) for r in rows) if rows else None


def bounded_sample(rows: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class of ``label`` (0 and 1), those with the
    smallest hash of ``key``: a bounded sample that does not depend on partitioning."""
    h = F.xxhash64(F.col(key), F.lit(7))
    return rows.filter(F.col(label) == 0).orderBy(h, key).limit(per_class).unionByName(
        rows.filter(F.col(label) == 1).orderBy(h, key).limit(per_class))
