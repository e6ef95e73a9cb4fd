"""Gradient-boosted trees for a yes/no label, with monotonic constraints, flattened into numpy node arrays.

Training works on a bounded sample of feature rows (see ``quality.fit_quality``), scoring on whole columns: every
tree level is one gather per row over arrays ``feature``, ``threshold``, ``left``, ``right``, ``value``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees in one set of arrays. A leaf points to itself; ``roots`` holds the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Chance of the positive label for each row of ``x`` (rows x features)."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, bins: int = 64, rate: float = 0.2, least: int = 10, ridge: float = 1.0
) -> FlatTrees:
    """Fit by second-order boosting on histograms. ``signs``: 1 rising, -1 falling, 0 free, per feature.

    A constrained feature is split only so that its left leaf value stands in the asked order to the right one, and the
    values below are clamped at the middle of both, which keeps the whole ensemble monotonic in that feature. One class
    only gives trees of one leaf; no rows give probability 1/2 + 0.
    """
    y = np.asarray(y, float)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if len(x) else np.empty(x.shape, int)
    nodes: list[list[float]] = []
    roots = []
    score = np.full(len(y), base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def weight(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + ridge), low), high)

    def gain_of(g, h, w):
        return -(g * w + 0.5 * (h + ridge) * w * w)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = weight(total_g, total_h, low, high)
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                cg, ch, cn = (np.cumsum(np.bincount(b, weights=v, minlength=len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                wl = np.clip(-cg / (ch + ridge), low, high)
                wr = np.clip(-(total_g - cg) / (total_h - ch + ridge), low, high)
                gains = gain_of(cg, ch, wl) + gain_of(total_g - cg, total_h - ch, wr) - gain_of(total_g, total_h, own)
                bad = (cn < least) | (len(rows) - cn < least) | (signs[f] * (wr - wl) < 0)
                gains[bad] = -np.inf
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (f, k, wl[k], wr[k]))
        if best[1] is None:
            return leaf(rate * own)
        f, k, wl, wr = best[1]
        here = leaf(0.0)
        middle = (wl + wr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
        goes = binned[rows, f] <= k
        a = grow(rows[goes], g, h, level + 1, *bounds[0])
        b = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[here] = [f, edges[f][k], a, b, 0.0]
        return here

    def flat(some: list[int]) -> FlatTrees:
        table = np.array(nodes, float).reshape(-1, 5)
        return FlatTrees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(some, int), depth, base)

    for _ in range(trees if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        root = grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf)
        roots.append(root)
        one = flat([root])
        one.base = 0.0
        odds = one.probability(x)
        score += np.log(odds / (1 - odds))
    return flat(roots)
