"""Histogram gradient-boosted trees for a binary target, in numpy.

Features are cut into quantile bins once; every tree of fixed depth is grown
level by level from per-node histograms of gradients and hessians. A fitted
model is a few flat arrays (nodes of a complete binary tree per tree), so
scoring a batch is ``depth`` vectorised steps per tree. ``fit`` takes the rows
of one machine, ``fit_blocks`` the rows of a cluster, one Spark job per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import RDD


@dataclass(frozen=True)
class Trees:
    depth: int
    base: float               # log odds before the first tree
    feature: np.ndarray       # (trees, 2**depth - 1) int32
    threshold: np.ndarray     # (trees, 2**depth - 1) float64; +inf: everything goes left
    leaf: np.ndarray          # (trees, 2**depth) float64

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of ``x`` (rows, features)."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = 2 ** self.depth - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def constant(rate: float, depth: int = 1) -> Trees:
    """A model without trees: every row has the given probability."""
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    n = 2 ** depth
    return Trees(depth, float(np.log(rate / (1 - rate))), np.zeros((0, n - 1), np.int32),
                 np.zeros((0, n - 1)), np.zeros((0, n)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Distinct inner quantiles of every feature; a value v is in bin
    ``searchsorted(edges, v, side="left")``, i.e. right of every edge below it."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, cuts, method="lower")) for column in x.T]


def best_splits(hg: np.ndarray, hh: np.ndarray, edges: list[np.ndarray], l2: float,
                min_hessian: float) -> tuple[np.ndarray, np.ndarray]:
    """(feature, edge number) of the best split of every node from its histograms
    (nodes, features, bins) of gradients and hessians; -1: no split gains."""
    feature, edge = np.zeros(len(hg), np.int32), np.full(len(hg), -1)
    best = np.full(len(hg), 1e-6)
    for f, cuts in enumerate(edges):
        lg, lh = hg[:, f].cumsum(1)[:, :-1], hh[:, f].cumsum(1)[:, :-1]
        tg, th = hg[:, f].sum(1, keepdims=True), hh[:, f].sum(1, keepdims=True)
        rg, rh = tg - lg, th - lh
        gain = lg ** 2 / (lh + l2) + rg ** 2 / (rh + l2) - tg ** 2 / (th + l2)
        gain[(lh < min_hessian) | (rh < min_hessian)] = 0
        at = gain[:, :len(cuts)]
        if not at.size:
            continue
        k = at.argmax(1)
        value = at[np.arange(len(hg)), k]
        better = value > best
        best[better], feature[better], edge[better] = value[better], f, k[better]
    return feature, edge


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4,
        rate: float = 0.15, bins: int = 64, l2: float = 2.0, min_hessian: float = 2.0) -> Trees:
    """Fit to labels 0/1. One class only, or no rows: a constant model with the
    smoothed share of ones."""
    w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=float)
    y = np.asarray(y, dtype=float)
    share = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1.0)
    if len(y) == 0 or y.min() == y.max():
        return constant(share, depth)
    edges = bin_edges(x, bins)
    width = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    features = x.shape[1]
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    out_f, out_t, out_l = [], [], []
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = w * (p - y), w * p * (1 - p)
        feature = np.zeros(inner, np.int32)
        threshold = np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            hg, hh = np.empty((count, features, width)), np.empty((count, features, width))
            for f in range(features):
                slot = (node - first) * width + binned[:, f]
                hg[:, f] = np.bincount(slot, weights=g, minlength=count * width).reshape(count, width)
                hh[:, f] = np.bincount(slot, weights=h, minlength=count * width).reshape(count, width)
            chosen, edge = best_splits(hg, hh, edges, l2, min_hessian)
            feature[first:first + count] = chosen
            threshold[first:first + count] = [edges[f][k] if k >= 0 else np.inf for f, k in zip(chosen, edge)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_of = node - inner
        sg = np.bincount(leaf_of, weights=g, minlength=leaves)
        sh = np.bincount(leaf_of, weights=h, minlength=leaves)
        leaf = -rate * sg / (sh + l2)
        margin += leaf[leaf_of]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(leaf)
    return Trees(depth, base, np.array(out_f), np.array(out_t), np.array(out_l))


# Histograms of a cluster are sums of whole numbers of 1 / SCALE: the same on
# every run and however the rows are dealt over tasks.
SCALE = 1 << 24
NO_SPLIT = 255           # above every bin: all rows go left
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row after ``levels`` splits, counted from 0 on its level."""
    rows, node = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
    return node - (2 ** levels - 1)


def _histograms(blocks: Iterator[Block], base: float, grown: list, feature: np.ndarray, cut: np.ndarray,
                level: int, depth: int, shape: tuple[int, int]) -> Iterator[np.ndarray]:
    """Gradients and hessians of a task's rows by node of the level, feature and bin."""
    features, width = shape
    size = 2 ** level * features * width
    out = np.zeros((2, size), np.int64)
    for bins, zeros, ones in blocks:
        margin = np.full(len(bins), base)
        for old_feature, old_cut, leaf in grown:
            margin += leaf[_walk(bins, old_feature, old_cut, depth)]
        p = sigmoid(margin)
        slot = (_walk(bins, feature, cut, level)[:, None] * features + np.arange(features)) * width + bins
        for i, value in enumerate((zeros * p - ones * (1 - p), (zeros + ones) * p * (1 - p))):
            whole = np.repeat(np.rint(value * SCALE), features)
            out[i] += np.bincount(slot.ravel(), weights=whole, minlength=size).astype(np.int64)
    yield out


def fit_blocks(blocks: RDD, edges: list[np.ndarray], zeros: int, ones: int, trees: int = 80, depth: int = 4,
               rate: float = 0.15, l2: float = 2.0, min_hessian: float = 2.0) -> Trees:
    """``fit`` on rows that stay on the cluster. ``blocks`` holds (bins, zeros,
    ones): the bin numbers (``bin_edges``, at most 255 a feature) of distinct rows
    as uint8, and how often each has label 0 and 1; ``zeros`` and ``ones`` are the
    totals. Every level is one job whose tasks send their histograms, whose size
    does not depend on the rows."""
    share = (ones + 0.5) / (zeros + ones + 1.0)
    if not zeros or not ones:
        return constant(share, depth)
    base, width = float(np.log(share / (1 - share))), max(len(e) for e in edges) + 1
    inner, leaves = 2 ** depth - 1, 2 ** depth
    grown, thresholds = [], []
    for _ in range(trees):
        feature, cut = np.zeros(inner, np.int32), np.full(inner, NO_SPLIT)
        threshold, leaf = np.full(inner, np.inf), np.zeros(leaves)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            task = partial(_histograms, base=base, grown=grown, feature=feature, cut=cut, level=level, depth=depth,
                           shape=(len(edges), width))
            hg, hh = (blocks.mapPartitions(task).reduce(np.add) / SCALE).reshape(2, count, len(edges), width)
            chosen, edge = best_splits(hg, hh, edges, l2, min_hessian)
            for i in np.flatnonzero(edge >= 0):
                feature[first + i], cut[first + i] = chosen[i], edge[i]
                threshold[first + i] = edges[chosen[i]][edge[i]]
        for i in range(count):                       # the children of the last level
            g, h, k = hg[i, feature[first + i]], hh[i, feature[first + i]], cut[first + i] + 1
            leaf[2 * i], leaf[2 * i + 1] = -rate * g[:k].sum() / (h[:k].sum() + l2), -rate * g[k:].sum() / (h[k:].sum() + l2)
        grown.append((feature, cut, leaf))
        thresholds.append(threshold)
    return Trees(depth, base, np.array([f for f, _, _ in grown]), np.array(thresholds), np.array([v for _, _, v in grown]))
