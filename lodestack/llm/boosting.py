"""Gradient-boosted trees for two classes, small and in numpy, grown on sums over all rows, in memory or by the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import cut as cut_off

#: Distinct rows of binned features that the driver fits on at most; of more, the tasks send it their sums, with equal results.
CELLS = 500_000
# Steps in one unit of a feature at which bins may end, and how far from zero they may; parts of a unit that gradients are
# rounded to, so that their sums do not depend on their order; bits of a bin's number.
STEPS, REACH, UNIT, BITS = 64, 1 << 14, 65536.0, 5

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def _nodes(codes: np.ndarray, feature: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    """Where rows of bins get to in a tree after some levels."""
    node, rows = np.zeros(len(codes), int), np.arange(len(codes))
    for level in range(levels):
        f = np.where(node >= 2**level - 1, feature[np.minimum(node, len(feature) - 1)], -1)
        node = np.where(f >= 0, 2 * node + 1 + (codes[rows, np.maximum(f, 0)] > at[np.minimum(node, len(at) - 1)]), node)
    return node


def _sums(codes: np.ndarray, mass: tuple[np.ndarray, np.ndarray, np.ndarray], score: np.ndarray, node: np.ndarray, level: int, bins: int) -> np.ndarray:
    """Gradients, curvatures and rows by node of a level, feature and bin, in whole parts of a unit.

    ``mass``: how many rows each row stands for, and what those of either class weigh."""
    n, pos, neg = mass
    q = 1 / (1 + np.exp(-score))
    g, h = np.rint((pos * (1 - q) - neg * q) * UNIT), np.rint((pos + neg) * q * (1 - q) * UNIT)
    first, count = 2**level - 1, 2**level
    here = np.flatnonzero(node >= first)
    own = (node[here] - first) * bins
    out = np.zeros((3, count, codes.shape[1], bins))
    for f in range(codes.shape[1]):
        place = own + codes[here, f]
        for k, v in enumerate((g, h, n)):
            out[k, :, f] = np.bincount(place, v[here], count * bins).reshape(count, bins)
    return out


def _unpacked(cell: np.ndarray, width: int) -> np.ndarray:
    return np.stack([(cell >> (BITS * f)) & (2**BITS - 1) for f in range(width)], axis=1)


class Boost:
    """Logistic loss, trees of fixed depth grown level by level on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[Tree] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boost:
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(y):
            return self
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        return self._fit_codes(codes, (np.ones(len(y)), w * y, w * (1 - y)), edges)

    def fit_rows(self, rows: DataFrame, width: int, even: bool = False) -> Boost:
        """The fit on all of ``x, y``: features, ``width`` of them, and class; ``even`` gives both classes the same weight.

        Bins are quantiles of all rows, to a step of ``1 / STEPS``. Rows of equal bins are counted, and
        the driver fits on the counts; of more than ``CELLS`` the tasks sum gradients, level by level."""
        seen = rows.mapInArrow(_values(width), "f int, v int, n bigint").groupBy("f", "v").agg(F.sum("n").alias("n")).orderBy("f", "v").toArrow()
        f, v, n = (np.asarray(c) for c in seen.columns)
        if not len(f):
            return self
        edges = []
        for k in range(width):
            at, upto = v[f == k], n[f == k].cumsum()
            picked = np.unique(np.searchsorted(upto, np.linspace(0, 1, self.bins + 1)[1:-1] * upto[-1]))
            edges.append((at[picked[picked < len(at) - 1]] + 0.5) / STEPS)
        cells = cut_off(rows.mapInArrow(_cells(edges), "cell bigint, pos bigint, neg bigint").groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
        size, pos, neg = cells.agg(F.count("*"), F.sum("pos"), F.sum("neg")).first()
        weights = (1.0, pos / neg) if even and pos and neg else (1.0, 1.0)
        if size <= CELLS:
            cell, p, q = (np.asarray(c) for c in cells.orderBy("cell").toArrow().columns)
            return self._fit_codes(_unpacked(cell, width), ((p + q).astype(float), p * weights[0], q * weights[1]), edges)
        self._start(pos * weights[0], neg * weights[1])
        if not pos or not neg:
            return self
        sc = rows.sparkSession.sparkContext

        def sums(grown: list[Tree], feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
            sent = sc.broadcast((grown, feature, at))
            parts = cells.mapInArrow(_task_sums(sent, self.base, weights, level, self.depth, width, self.bins), "s binary").toArrow().column(0).to_pylist()
            sent.unpersist()
            return sum(np.frombuffer(s) for s in parts).reshape(3, 2**level, width, self.bins)

        return self._grow(edges, sums)

    def _start(self, pos: float, neg: float) -> None:
        p = np.clip(pos / max(pos + neg, 1e-9), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))

    def _fit_codes(self, codes: np.ndarray, mass: tuple[np.ndarray, np.ndarray, np.ndarray], edges: list[np.ndarray]) -> Boost:
        self._start(mass[1].sum(), mass[2].sum())
        if not mass[1].any() or not mass[2].any():
            return self
        score, done = np.full(len(codes), self.base), 0

        def sums(grown: list[Tree], feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
            nonlocal score, done
            for f, k, leaves in grown[done:]:
                score = score + leaves[_nodes(codes, f, k, self.depth)]
            done = len(grown)
            return _sums(codes, mass, score, _nodes(codes, feature, at, level), level, self.bins)

        return self._grow(edges, sums)

    def _grow(self, edges: list[np.ndarray], sums: Callable[[list[Tree], np.ndarray, np.ndarray, int], np.ndarray]) -> Boost:
        """Trees from sums over all rows; those that ``sums`` is given have numbers of bins for their cuts."""
        grown: list[Tree] = []
        n_inner = 2**self.depth - 1
        for _ in range(self.rounds):
            feature, at, cut = np.full(n_inner, -1), np.zeros(n_inner, int), np.zeros(n_inner)
            num, den = np.zeros(2 * n_inner + 1), np.zeros(2 * n_inner + 1)
            for level in range(self.depth):
                g, h, n = sums(grown, feature, at, level).cumsum(axis=3)
                g, h = g / UNIT, h / UNIT
                for k in range(2**level):
                    here, sg, sh, sn = 2**level - 1 + k, g[k], h[k], n[k]
                    total_g, total_h, total_n = sg[0, -1], sh[0, -1], sn[0, -1]
                    num[here], den[here] = total_g, total_h
                    if total_n < 2 * self.least:
                        continue
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    gain[(sn < self.least) | (total_n - sn < self.least)] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-6:
                        feature[here], at[here], cut[here] = f, b, edges[f][b]
                        num[2 * here + 1 : 2 * here + 3] = sg[f, b], total_g - sg[f, b]
                        den[2 * here + 1 : 2 * here + 3] = sh[f, b], total_h - sh[f, b]
            leaves = self.rate * num / (den + 1)
            grown.append((feature, at, leaves))
            self.trees.append((feature, cut, leaves))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for feature, cut, leaves in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = node < len(feature)
                f = np.where(inner, feature[np.minimum(node, len(feature) - 1)], -1)
                go = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[np.minimum(node, len(cut) - 1)]
                node = np.where(go, 2 * node + 1 + right, node)
            score += leaves[node]
        return 1 / (1 + np.exp(-score))


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(b.column("x").flatten()).reshape(b.num_rows, width)


def _values(width: int):
    """How often each feature has each value, to a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 2 * REACH + 1), np.int64)
        for b in batches:
            v = (np.clip(np.rint(_matrix(b, width) * STEPS), -REACH, REACH) + REACH).astype(int)
            for f in range(width):
                n = np.bincount(v[:, f])
                total[f, : len(n)] += n
        f, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array((v - REACH).astype(np.int32)), pa.array(total[f, v])], names=["f", "v", "n"])

    return run


def _cells(edges: list[np.ndarray]):
    """Bins of all features in one number, with how many rows of either class have them in a batch or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cell, pos, neg = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int64)
            held.clear()
            cell, at = np.unique(cell, return_inverse=True)
            kinds = [np.bincount(at, v, len(cell)).astype(np.int64) for v in (pos, neg)]
            return pa.RecordBatch.from_arrays([pa.array(cell), *map(pa.array, kinds)], names=["cell", "pos", "neg"])

        rows = 0
        for b in batches:
            x, y = _matrix(b, len(edges)), np.asarray(b.column("y")).astype(np.int64)
            cell = np.zeros(len(x), np.int64)
            for f, e in enumerate(edges):
                cell |= np.searchsorted(e, x[:, f], side="left").astype(np.int64) << (BITS * f)
            held.append(np.stack([cell, y, 1 - y]))
            rows += len(x)
            if rows > 500_000:
                yield flush()
                rows = 0
        yield flush()

    return run


def _task_sums(sent, base: float, weights: tuple[float, float], level: int, depth: int, width: int, bins: int):
    """A task's own sums over its cells; trees so far give their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, feature, at = sent.value
        total = np.zeros((3, 2**level, width, bins))
        for b in batches:
            cell, p, q = (np.asarray(c) for c in b.columns)
            codes, score = _unpacked(cell, width), np.full(len(cell), base)
            for f, k, leaves in grown:
                score = score + leaves[_nodes(codes, f, k, depth)]
            total += _sums(codes, ((p + q).astype(float), p * weights[0], q * weights[1]), score, _nodes(codes, feature, at, level), level, bins)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return run
