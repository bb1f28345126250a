"""Gradient-boosted regression trees with logistic loss over a few numeric features, for small training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    trees: list[list[tuple[int, float, float]]]  # by node of a full binary tree: feature or -1, threshold, leaf value
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            feature, threshold, value = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at].astype(np.int64)
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))) if len(x) else np.zeros(0)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, node: int, tree: list, rate: float) -> None:
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth and len(rows) >= 20:
        for f, c in enumerate(cuts):
            if not c.size:
                continue
            bins = np.searchsorted(c, x[rows, f], side="left")
            gl, hl = (np.cumsum(np.bincount(bins, weights=v[rows], minlength=c.size + 1))[:-1] for v in (g, h))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(hl < 1e-3) | (hs - hl < 1e-3)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(c[k]))
    if best[1] < 0:
        tree[node] = (-1, 0.0, rate * -gs / (hs + 1))
        return
    tree[node] = (best[1], best[2], 0.0)
    right = x[rows, best[1]] > best[2]
    _grow(x, g, h, rows[~right], cuts, depth - 1, 2 * node + 1, tree, rate)
    _grow(x, g, h, rows[right], cuts, depth - 1, 2 * node + 2, tree, rate)


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> Trees:
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4) if len(y) else 0.5
    model = Trees(float(np.log(p / (1 - p))), [], depth)
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1], method="lower")) for f in range(x.shape[1])]
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (depth + 1) - 1)
        _grow(x, p - y, p * (1 - p), np.arange(len(y)), cuts, depth, 0, tree, rate)
        one = Trees(0.0, [tree], depth)
        raw += one.raw(x)
        model.trees.append(tree)
    return model
