"""Second-order (Newton) gradient boosting on histograms, after Chen & Guestrin (2016).

Rows are binned once and packed into sparse blocks: per block the (feature, bin) codes of its rows that
differ from the bin of 0, sorted by code, with labels, margins and a sampling key. The blocks are a
written table; a tree level is one pass over them:

  tasks     margins of the rounds since the last written margins and the node of every row are worked
            out from the block (a few gathers per tree level), then the gradients are added up
            per (node, feature, bin) with one ``bincount`` per output
  Spark     sums the tasks' histograms by key
  driver    picks the best split per node (gain - gamma, L2 lambda)

Only the lighter child of a split is counted, its sibling is the parent less the child; the bin of 0 is
the node's total less the bins that were counted. Gradients are added as whole numbers (scaled by a
power of two that the loss bounds), so all of this is exact and the trees do not depend on how rows are
partitioned. Every ``checkpoint_interval`` rounds the margins are written with their blocks; a lost
executor costs the tasks that it ran.

Bin edges come from counts of values by the leading bits of their order-preserving 64-bit form. Cells
that hold more than a quarter bin are split further until they hold one value, so the edges, too,
depend on the rows alone. Missing values (NaN) have a last bin of their own and go right.

Rows are sampled by a hash of features, label and (if given) ``key_cols``; rows equal in all of these are
drawn together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.trees import FlatTrees
from tessera.session import scratch_path, ship

BLOCK_ROWS = 8192
BLOCK_ENTRIES = 1 << 21
FIRST_BITS, MORE_BITS = 12, 8
GRADIENT_BITS, SUM_BITS = 38, 61     # a block's sums stay exact in doubles, all rows' in longs


@dataclass
class NewtonBoostParams:
    objective: str = "squared"          # squared | logistic | softmax
    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    gamma: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    max_bins: int = 64
    seed: int = 42
    checkpoint_interval: int = 5
    num_class: int = 1


@dataclass
class NewtonBoostModel:
    """Trees over feature values (thresholds, not bins); one ensemble per output."""
    params: NewtonBoostParams
    n_features: int
    edges: list[list[float]]
    base: list[float]
    trees: list[FlatTrees] = field(default_factory=list)

    def transform(self, df: DataFrame, features_col: str = "features",
                  prediction_col: str = "prediction", probability_col: str = "probability") -> DataFrame:
        taken = {c.lower() for c in df.columns}
        own = next(n for n in (f"_values{i}" for i in range(len(taken) + 1)) if n not in taken)
        rows = df.withColumn(own, vector_to_array(F.col(features_col)))
        margins = [t.predict_on_array(F.col(own)) + F.lit(b) for t, b in zip(self.trees, self.base)]
        obj = self.params.objective
        if obj == "squared":
            out = rows.withColumn(prediction_col, margins[0])
        elif obj == "logistic":
            p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-margins[0]))
            out = (rows.withColumn(probability_col, F.array(F.lit(1.0) - p1, p1))
                   .withColumn(prediction_col, F.when(p1 > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))))
        else:
            m = F.array(*margins)
            mx = F.array_max(m)
            ex = F.transform(m, lambda v: F.exp(v - mx))
            tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
            probs = F.transform(ex, lambda v: v / tot)
            out = (rows.withColumn(probability_col, probs)
                   .withColumn(prediction_col, (F.array_position(probs, F.array_max(probs)) - 1).cast("double")))
        return out.drop(own)


# ------------------------------------------------------------------ rows as entries
def _raw(features: Column) -> tuple[Column, Column]:
    """(indices or null for a dense vector, values) of a vector column."""
    v = F.unwrap_udt(features)
    return v["indices"].alias("at"), v["values"].alias("v")


def _entries(at: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the entries of a batch that are not 0."""
    n = np.diff(values.offsets.to_numpy()).astype(np.int64)
    v = values.flatten().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    feature = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
    sparse = np.asarray(at.is_valid())
    if sparse.any():
        feature[sparse[row]] = at.flatten().to_numpy()
    keep = v != 0
    return row[keep], feature[keep], v[keep]


def _ordered(v: np.ndarray) -> np.ndarray:
    """64-bit whole numbers in the order of the doubles."""
    bits = np.ascontiguousarray(v).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = (key ^ (1 << 63)) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.asarray([bits], np.uint64).view(np.float64)[0])


def _cells(depth: int, heavy: dict[int, np.ndarray]):
    """Counts of values by their first bits: at depth 0 by FIRST_BITS, else inside the ``heavy`` cells
    (feature -> sorted leading bits at ``depth``) by up to MORE_BITS further ones."""
    bits = FIRST_BITS if depth == 0 else min(MORE_BITS, 64 - depth)

    def run(batches):
        for b in batches:
            _, f, v = _entries(b.column(0), b.column(1))
            known = ~np.isnan(v)
            f, k = f[known], _ordered(v[known])
            if depth:
                parts = []
                order = np.argsort(f, kind="stable")
                f, k = f[order], k[order]
                for g, cells in heavy.items():
                    a, z = np.searchsorted(f, [g, g + 1])
                    lead = k[a:z] >> np.uint64(64 - depth)
                    hit = np.minimum(np.searchsorted(cells, lead), len(cells) - 1)
                    parts.append(a + np.flatnonzero(cells[hit] == lead))
                keep = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                f, k = f[keep], k[keep]
            lead = k >> np.uint64(64 - depth - bits)
            order = np.lexsort((k, f))
            f, k, lead = f[order], k[order], lead[order]
            first = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (lead[1:] != lead[:-1])])) if len(f) else np.zeros(0, np.int64)
            last = np.concatenate([first[1:], [len(f)]]) - 1 if len(f) else first
            flip = np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f[first].astype(np.int32)), pa.array((k[first] ^ flip).view(np.int64)), pa.array((k[last] ^ flip).view(np.int64)),
                 pa.array((last - first + 1).astype(np.int64)), pa.array(lead[first].view(np.int64))], ["f", "lo", "hi", "n", "cell"])

    return run


def bin_edges(rows: DataFrame, n_features: int, max_bins: int, n_rows: int) -> list[list[float]]:
    """Cut points per feature (value >= cut goes to the higher bin), near the quantiles i / max_bins.
    ``rows`` has the columns (at, v) of ``_raw``. Collects cells: per feature and pass at most 256 for each of 4 x max_bins heavy ones."""
    done: list[list[tuple[int, int, int]]] = [[] for _ in range(n_features)]       # (least, greatest, count) by feature
    missing = rows.select(F.explode(F.filter("v", F.isnan)).alias("x"), "at").limit(1).count()
    depth, heavy = 0, {}
    while True:
        found = rows.mapInArrow(_cells(depth, heavy), "f int, lo long, hi long, n long, cell long").groupBy("f", "cell").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toArrow()
        f, cell, lo, hi, n = (found.column(c).to_numpy() for c in ("f", "cell", "lo", "hi", "n"))
        flip = np.uint64(1 << 63)
        lo, hi, cell = lo.view(np.uint64) ^ flip, hi.view(np.uint64) ^ flip, cell.view(np.uint64)
        split = (n * 4 * max_bins > n_rows) & (lo != hi)
        for i in np.flatnonzero(~split):
            done[f[i]].append((int(lo[i]), int(hi[i]), int(n[i])))
        depth += FIRST_BITS if depth == 0 else min(MORE_BITS, 64 - depth)
        if not split.any():
            break
        heavy = {int(g): np.sort(cell[split & (f == g)]) for g in np.unique(f[split])}
    zero = int(_ordered(np.zeros(1))[0])
    gaps = _missing_counts(rows, n_features) if missing else np.zeros(n_features, np.int64)
    edges = []
    for g, cells in enumerate(done):
        rest = n_rows - sum(c for _, _, c in cells) - int(gaps[g])
        cells = sorted(cells + ([(zero, zero, rest)] if rest else []))
        total, cuts, upto, i = n_rows - int(gaps[g]), [], 0, 1
        for j, (least, _, count) in enumerate(cells):
            upto += count
            cut = False
            while i < max_bins and upto * max_bins > i * total:
                cut, i = True, i + 1
            if cut and j:
                cuts.append(_value(least))
        edges.append(cuts)
    return edges


def _missing_counts(rows: DataFrame, n_features: int) -> np.ndarray:
    def run(batches):
        for b in batches:
            _, f, v = _entries(b.column(0), b.column(1))
            g, n = np.unique(f[np.isnan(v)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(n.astype(np.int64))], ["f", "n"])

    out = np.zeros(n_features, np.int64)
    for r in rows.mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():     # a row per feature
        out[r.f] = r.n
    return out


# ------------------------------------------------------------------ blocks
@dataclass(frozen=True)
class Bins:
    """Codes of (feature, bin): those of feature f start at ``first[f]``; the last one is for missing values."""
    edges: tuple
    first: np.ndarray
    zero: np.ndarray             # code of the value 0 per feature

    @staticmethod
    def of(edges: list[list[float]]) -> Bins:
        cuts = tuple(np.asarray(e, np.float64) for e in edges)
        first = np.concatenate([[0], np.cumsum([len(e) + 2 for e in cuts])]).astype(np.int64)
        zero = np.asarray([int(np.searchsorted(e, 0.0, "right")) for e in cuts], np.int64) + first[:-1]
        return Bins(cuts, first, zero)

    def codes(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.argsort(feature, kind="stable")
        out = np.empty(len(feature), np.int64)
        f, v = feature[order], value[order]
        for g in np.unique(f).tolist():
            a, z = np.searchsorted(f, [g, g + 1])
            out[a:z] = self.first[g] + np.searchsorted(self.edges[g], v[a:z], "right")
        out[np.isnan(v)] = self.first[f[np.isnan(v)] + 1] - 1
        back = np.empty_like(out)
        back[order] = out
        return back


class Block:
    def __init__(self, code, row, label, key, margin):
        self.code, self.row, self.label, self.key, self.margin = code, row, label, key, margin

    @staticmethod
    def read(b: pa.RecordBatch, i: int, outputs: int) -> Block:
        code, row, label, key, margin = (b.column(k)[i].as_py() for k in range(5))
        return Block(np.frombuffer(code, np.int32), np.frombuffer(row, np.uint16), np.frombuffer(label, np.float64),
                     np.frombuffer(key, np.uint64), np.frombuffer(margin, np.float64).reshape(-1, outputs))

    def arrow(self) -> pa.RecordBatch:
        parts = (self.code.astype(np.int32), self.row.astype(np.uint16), self.label, self.key, self.margin)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], _BLOCK)

    def leaves(self, nodes: list[dict], bins: Bins) -> np.ndarray:
        """Node of a tree that every row reaches."""
        at, held = np.zeros(len(self.label), np.int64), {}
        for i, n in enumerate(nodes):                   # children come after their parent
            if n["left"] < 0:
                continue
            f = n["feat"]
            if f not in held:
                c = np.full(len(at), bins.zero[f], np.int64)
                a, z = np.searchsorted(self.code, [bins.first[f], bins.first[f + 1]])
                c[self.row[a:z]] = self.code[a:z]
                held[f] = c
            here = at == i
            at[here] = np.where(held[f][here] - bins.first[f] <= n["bin"], n["left"], n["right"])
        return at

    def margins(self, rounds: list[list[list[dict]]], bins: Bins) -> np.ndarray:
        out = self.margin.copy()
        for trees in rounds:
            for k, nodes in enumerate(trees):
                out[:, k] += np.asarray([n["value"] for n in nodes])[self.leaves(nodes, bins)]
        return out


_BLOCK = ["code", "row", "label", "key", "margin"]
_BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in _BLOCK)


def _pack(bins: Bins, base: list[float]):
    def block(parts) -> pa.RecordBatch:
        at, rows, codes = 0, [], []
        for n, r, c, _, _ in parts:
            rows.append(r + at)
            codes.append(c)
            at += n
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        label, key = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
        return Block(code[order], row[order], label, key, np.tile(np.asarray(base, np.float64), (at, 1))).arrow()

    def run(batches):
        parts, rows, entries = [], 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                r, f, v = _entries(part.column(0), part.column(1))
                c = bins.codes(f, v)
                keep = c != bins.zero[f]
                parts.append((part.num_rows, r[keep], c[keep], part.column(2).to_numpy(), part.column(3).to_numpy().view(np.uint64)))
                rows, entries = rows + part.num_rows, entries + int(keep.sum())
                if rows > BLOCK_ROWS - 1024 or entries >= BLOCK_ENTRIES:
                    yield block(parts)
                    parts, rows, entries = [], 0, 0
        if parts:
            yield block(parts)

    return run


def _gradients(objective: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if objective == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y[:, None], np.maximum(p * (1.0 - p), 1e-16)
    p = np.exp(margin - margin.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p - (y[:, None] == np.arange(margin.shape[1])), np.maximum(2.0 * p * (1.0 - p), 1e-16)


def _drawn(key: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Rows of a round's sample: a hash of key, seed and round (the finaliser of SplitMix64) below ``share``."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((seed * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) & (2 ** 64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64 < share


def _histograms(p: NewtonBoostParams, bins: Bins, outputs: int, rounds, trees, slots: list[dict[int, int]], turn: int,
                scale: tuple[float, float]):
    """A task's sums per slot and code: slots[k] numbers the nodes of output k that are counted. A slot's last sum is its total."""
    width, count = int(bins.first[-1]) + 1, sum(map(len, slots))

    def run(batches):
        g_all, h_all = np.zeros(count * width, np.int64), np.zeros(count * width, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                block = Block.read(b, i, outputs)
                g, h = _gradients(p.objective, block.margins(rounds, bins), block.label)
                sample = _drawn(block.key, p.seed, turn, p.subsample) if p.subsample < 1.0 else np.ones(len(g), bool)
                for k in range(outputs):
                    if not slots[k]:
                        continue
                    slot_of = np.full(len(trees[k]), -1)
                    slot_of[list(slots[k])] = list(slots[k].values())
                    slot = np.where(sample, slot_of[block.leaves(trees[k], bins)], -1)
                    gk, hk = np.rint(g[:, k] * scale[0]), np.rint(h[:, k] * scale[1])
                    rows = np.flatnonzero(slot >= 0)
                    use = slot[block.row] >= 0
                    row, code = block.row[use], block.code[use]
                    at = np.concatenate([slot[row] * width + code, slot[rows] * width + width - 1])
                    row = np.concatenate([row, rows])
                    low = min(slots[k].values()) * width                 # an output's slots are consecutive
                    size = len(slots[k]) * width
                    g_all[low:low + size] += np.bincount(at - low, gk[row], size).astype(np.int64)
                    h_all[low:low + size] += np.bincount(at - low, hk[row], size).astype(np.int64)
        some = np.flatnonzero((g_all != 0) | (h_all != 0))
        for lo in range(0, len(some), 100_000):
            s = some[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(g_all[s]), pa.array(h_all[s])], ["at", "g", "h"])

    return run


def _advance(bins: Bins, outputs: int, rounds):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                block = Block.read(b, i, outputs)
                block.margin = block.margins(rounds, bins)
                yield block.arrow()

    return run


# ------------------------------------------------------------------ splits
def best_splits(hist: np.ndarray, first: np.ndarray, lam: float, gamma: float, mcw: float) -> list[tuple[int, int] | None]:
    """hist[slot, code, 2] -> (feature, last bin that goes left) per slot, or None."""
    feature = np.repeat(np.arange(len(first) - 1), np.diff(first))
    run = np.cumsum(hist, axis=1)
    before = np.where((first[:-1] > 0)[:, None], run[:, np.maximum(first[:-1] - 1, 0)], 0)        # [slot, feature, 2]
    left = run - before[:, feature]
    total = run[:, first[1:] - 1] - before
    whole = total[:, feature]
    right = whole - left
    (gl, hl), (gr, hr), (g, h) = (np.moveaxis(x, -1, 0) for x in (left, right, whole))
    gain = 0.5 * (gl ** 2 / (hl + lam) + gr ** 2 / (hr + lam) - g ** 2 / (h + lam)) - gamma
    gain[(hl < mcw) | (hr < mcw)] = -np.inf
    gain[:, first[1:] - 1] = -np.inf                                                             # nothing goes right
    out = []
    for row in gain:
        i = int(row.argmax()) if row.size else -1
        out.append((int(feature[i]), int(i - first[feature[i]])) if i >= 0 and row[i] > 0 else None)
    return out


class _Grower:
    """The driver's side of one boosting run."""

    def __init__(self, blocks: DataFrame, p: NewtonBoostParams, bins: Bins, outputs: int, n_rows: int):
        self.blocks, self.p, self.bins, self.outputs, self.n_rows = blocks, p, bins, outputs, n_rows

    def counted(self, rounds, trees, slots, turn, scale) -> np.ndarray:
        """Exact sums [slot, code, 2], the bin of 0 filled in."""
        width, count = int(self.bins.first[-1]) + 1, sum(map(len, slots))
        found = self.blocks.mapInArrow(_histograms(self.p, self.bins, self.outputs, rounds, trees, slots, turn, scale),
                                       "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros((count * width, 2), np.int64)
        at = found.column("at").to_numpy()
        out[at, 0], out[at, 1] = found.column("g").to_numpy(), found.column("h").to_numpy()
        out = out.reshape(count, width, 2)
        total, out = out[:, -1:], out[:, :-1]
        sums = np.add.reduceat(out, self.bins.first[:-1], axis=1) if out.shape[1] else out
        out[:, self.bins.zero] += total - sums
        return out

    def round(self, rounds, turn: int, scale: tuple[float, float]) -> list[list[dict]]:
        """The trees of one round, one per output, level by level."""
        p, unit = self.p, np.asarray([1 / scale[0], 1 / scale[1]])
        node = lambda hist: {"feat": -1, "bin": 0, "thr": 0.0, "left": -1, "right": -1, "value": 0.0, "hist": hist}
        trees = [[node(None)] for _ in range(self.outputs)]
        wanted = [{0: k} for k in range(self.outputs)]
        pairs: dict[tuple[int, int], tuple[int, int]] = {}            # counted child -> (sibling, parent)
        frontier = [(k, 0) for k in range(self.outputs)]
        for depth in range(p.max_depth):
            if not frontier:
                break
            hist = self.counted(rounds, trees, wanted, turn, scale)
            for k, nodes in enumerate(wanted):
                for i, slot in nodes.items():
                    trees[k][i]["hist"] = hist[slot]
                    if (k, i) in pairs:
                        sibling, parent = pairs[k, i]
                        trees[k][sibling]["hist"] = trees[k][parent]["hist"] - hist[slot]
            for k, i in pairs:
                trees[k][pairs[k, i][1]]["hist"] = None
            pairs, wanted, after = {}, [{} for _ in range(self.outputs)], []
            floats = np.stack([trees[k][i]["hist"] for k, i in frontier]) * unit
            for (k, i), h, split in zip(frontier, floats, best_splits(floats, self.bins.first, p.reg_lambda, p.gamma, p.min_child_weight)):
                n = trees[k][i]
                n["sums"] = h[:self.bins.first[1]].sum(0)
                if split is None:
                    n["hist"] = None
                    continue
                f, last = split
                a = self.bins.first[f]
                left = (n["hist"][a:a + last + 1].sum(0)) * unit
                li = len(trees[k])
                trees[k] += [node(None), node(None)]
                trees[k][li]["sums"], trees[k][li + 1]["sums"] = left, n["sums"] - left
                edges = self.bins.edges[f]
                # bin <= last says value < edges[last]
                n.update(feat=f, bin=last, left=li, right=li + 1,
                         thr=float(np.nextafter(edges[last], -np.inf)) if last < len(edges) else math.inf)
                light = li if left[1] <= n["sums"][1] / 2 else li + 1
                pairs[k, light] = (2 * li + 1 - light, i)
                wanted[k][light] = 0
                after += [(k, li), (k, li + 1)]
            slot = 0
            for nodes in wanted:
                for i in nodes:
                    nodes[i], slot = slot, slot + 1
            frontier = after
        for nodes in trees:
            for n in nodes:
                n.pop("hist", None)
                g, h = n.pop("sums", (0.0, 0.0))
                n["value"] = float(-p.learning_rate * g / (h + p.reg_lambda)) if n["left"] < 0 else 0.0
        return trees


def _power_of_two(x: float) -> float:
    return 2.0 ** math.floor(math.log2(x))


def _base(rows: DataFrame, label: Column, p: NewtonBoostParams, outputs: int, most: float, n: int) -> list[float]:
    """Starting margins; the mean label is added up in whole numbers, in any order the same."""
    if p.objective == "softmax" or not n:
        return [0.0] * outputs
    scale = _power_of_two(2.0 ** GRADIENT_BITS / most) if most else 1.0
    mean = float(rows.agg(F.sum(F.rint(label * F.lit(scale)).cast("decimal(38,0)")).alias("s")).first()["s"]) / scale / n
    if p.objective == "squared":
        return [mean]
    m = min(max(mean, 1e-6), 1 - 1e-6)
    return [math.log(m / (1 - m))]


def fit_newton_boost(df: DataFrame, features_col: str, label_col: str, params: NewtonBoostParams,
                     n_features: int, key_cols: list[str] | None = None) -> NewtonBoostModel:
    spark = df.sparkSession
    ship(spark)
    p, outputs = params, params.num_class if params.objective == "softmax" else 1
    label = F.col(label_col).cast("double")
    at, v = _raw(F.col(features_col))
    rows = df.select(at, v, label.alias("label"), F.xxhash64(F.unwrap_udt(F.col(features_col)), label, *[F.col(c) for c in key_cols or []]).alias("key"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)               # read by the passes over values, then written as blocks
    facts = rows.agg(F.count("*").alias("n"), F.max(F.abs("label")).alias("most")).first()
    n_rows, most = facts["n"], facts["most"] or 0.0
    base = _base(rows, F.col("label"), p, outputs, most, n_rows)
    edges = bin_edges(rows, n_features, p.max_bins, n_rows)
    model = NewtonBoostModel(p, n_features, edges, base, [FlatTrees(features=[]) for _ in range(outputs)])
    bins = Bins.of(edges)
    blocks = _written(rows.mapInArrow(_pack(bins, base), _BLOCK_SCHEMA), "boost-blocks")
    rows.unpersist()
    if not n_rows or not n_features:
        return model
    grower, since = _Grower(blocks, p, bins, outputs, n_rows), []
    reach = most + max(map(abs, base))                              # no squared-loss gradient is larger
    for turn in range(p.n_estimators):
        bound = reach if p.objective == "squared" else 1.0
        scale = tuple(_power_of_two(min(2.0 ** GRADIENT_BITS / b, 2.0 ** SUM_BITS / (n_rows * b))) for b in (max(bound, 1e-300), 1.0))
        trees = grower.round(since, turn, scale)
        for k, nodes in enumerate(trees):
            model.trees[k].add_tree([{x: n[x] for x in ("feat", "thr", "left", "right", "value")} for n in nodes], weight=1.0)
        reach += max(abs(n["value"]) for nodes in trees for n in nodes)
        since.append(trees)
        if len(since) == p.checkpoint_interval and turn + 1 < p.n_estimators:
            grower.blocks = _written(grower.blocks.mapInArrow(_advance(bins, outputs, since), _BLOCK_SCHEMA), "boost-blocks")
            since = []
    return model


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(c, T.BinaryType()) for c in _BLOCK])).parquet(path)
