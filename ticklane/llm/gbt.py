"""Histogram gradient-boosted trees for binary labels, flattened into arrays for vectorised numpy traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as complete binary arrays: node k has the children 2k + 1 and 2k + 2; a node with feature -1 is a leaf."""

    prior: float
    edges: list[np.ndarray]
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray  # trees x nodes: a row goes left if its value <= cut
    value: np.ndarray  # trees x nodes
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x; all rows walk down a tree together."""
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                down = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at])
                at = np.where(f >= 0, down, at)
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Newton boosting on log loss.  Without rows or with one class, the forest has no trees and gives the prior.

    Each level adds up gradients by (node, bin) for every feature with bincount and takes the split of greatest gain;
    equal gains go to the first feature and the lowest bin.
    """
    n, features = x.shape
    ones = float(y.sum())
    prior = float(np.log((ones + 1.0) / (n - ones + 1.0)))
    nodes = 2 ** (depth + 1) - 1
    none = Forest(prior, [], np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)), depth)
    if n == 0 or ones in (0, n):
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)])
    margin = np.full(n, prior)
    grown = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(n, np.int64)
        value[0] = -rate * g.sum() / (h.sum() + ridge)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            inside = at >= first
            local = at[inside] - first
            best = np.full(width, 1e-6)
            choice = [None] * width
            for f in range(features):
                size = bins + 1
                key = local * size + codes[f][inside]
                sums = [np.bincount(key, w, width * size).reshape(width, size) for w in (g[inside], h[inside], np.ones(len(key)))]
                left = [np.cumsum(s, axis=1) for s in sums]
                right = [s[:, -1:] - s for s in left]
                total = left[0][:, -1] ** 2 / (left[1][:, -1] + ridge)
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[:, None]
                gain[(left[2] < least) | (right[2] < least)] = -np.inf
                gain[:, len(edges[f]) :] = -np.inf
                top = gain.argmax(axis=1)
                for k in range(width):
                    if gain[k, top[k]] > best[k] * (1 + 1e-9):
                        best[k] = gain[k, top[k]]
                        b = top[k]
                        choice[k] = (f, b, left[0][k, b], left[1][k, b], right[0][k, b], right[1][k, b])
            moved = at.copy()
            for k, found in enumerate(choice):
                if found is None:
                    continue
                f, b, gl, hl, gr, hr = found
                node = first + k
                feature[node], cut[node] = f, edges[f][b]
                value[2 * node + 1], value[2 * node + 2] = -rate * gl / (hl + ridge), -rate * gr / (hr + ridge)
                here = at == node
                moved[here] = 2 * node + 1 + (codes[f][here] > b)
            at = moved
        margin += value[at]
        grown.append((feature, cut, value))
    return Forest(prior, edges, *[np.stack([t[i] for t in grown]) for i in range(3)], depth)
