"""Gradient-boosted trees with monotonic constraints, as flat NumPy node arrays.

``fit`` trains on a bounded sample (logistic loss, quantile bins);
``Forest.score`` walks all trees of all rows at once, level by level.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees one after another; a leaf has feature -1 and itself as children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    @property
    def decides(self) -> bool:
        """False for a constant."""
        return len(self.roots) > 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row of ``x``."""
        margin = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                f = self.feature[node]
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            margin = margin + self.value[node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 80, depth: int = 3, rate: float = 0.15,
        bins: int = 64, min_rows: int = 15, ridge: float = 1.0) -> Forest:
    """Fit P(y = 1). ``monotone[f]`` is +1, -1 or 0: the score never falls (rises) with feature ``f``.

    Splits that break a constraint are not taken, and the values of a constrained
    split's children are bounded by their midpoint further down. With no rows or
    one class only, the forest is the smoothed prior."""
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    nodes: list[list] = []
    roots: list[int] = []
    base = float(np.log(prior / (1 - prior)))
    if n < 2 * min_rows or len(np.unique(y)) < 2:
        trees = 0
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if trees else []
    coded = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]   # code <= b  <=>  x <= cuts[b]
    margin = np.full(n, base)

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + ridge), lo, hi))

    def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, rate * leaf(g, h, lo, hi)])
        if level == depth or len(rows) < 2 * min_rows:
            fitted[rows] = nodes[at][4]
            return at
        best = (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            code = coded[f][rows]
            gl = np.cumsum(np.bincount(code, grad[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(code, hess[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
            vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(g - gl) / (h - hl + ridge), lo, hi)
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            ok = (nl >= min_rows) & (len(rows) - nl >= min_rows) & (monotone[f] * (vr - vl) >= 0)
            gain = np.where(ok, gain, 0)
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (gain[b], (f, b, vl[b], vr[b]))
        if best[1] is None:
            fitted[rows] = nodes[at][4]
            return at
        f, b, vl, vr = best[1]
        mid, goes = (vl + vr) / 2, coded[f][rows] <= b
        low, high = ((lo, mid), (mid, hi)) if monotone[f] > 0 else ((mid, hi), (lo, mid)) if monotone[f] < 0 else ((lo, hi),) * 2
        one, two = grow(rows[goes], level + 1, *low), grow(rows[~goes], level + 1, *high)
        nodes[at] = [f, float(cuts[f][b]), one, two, 0.0]
        return at

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess, fitted = p - y, p * (1 - p), np.zeros(n)
        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
        margin = margin + fitted
    columns = list(zip(*nodes)) if nodes else [[]] * 5
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    arrays = [np.array(c, dtype=k) for c, k in zip(columns, kinds)]
    return Forest(*arrays, np.array(roots, dtype=np.int64), depth, base)
