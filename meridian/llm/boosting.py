"""Gradient-boosted trees on binned dense features, and isotonic calibration, in NumPy. For bounded samples on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: at each inner node go right if x[feature] > cut; leaves add to the log-odds."""

    base: float
    features: np.ndarray  # (trees, inner nodes)
    cuts: np.ndarray
    leaves: np.ndarray  # (trees, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss. Without both labels only the base rate remains."""
    n, width = x.shape
    p0 = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p0 / (1 - p0))), np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if not n or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # code > k exactly if x > edge k
    offset = np.arange(width) * bins
    flat = code + offset
    raw = np.full(n, model.base)
    fs, cs, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, m = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            hg = np.bincount(at, np.repeat(g, width), m * width * bins).reshape(m, width, bins).cumsum(axis=2)
            hh = np.bincount(at, np.repeat(h, width), m * width * bins).reshape(m, width, bins).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[(hh < least) | (th - hh < least)] = 0
            for k in range(m):
                f, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        raw += value[leaf]
        fs.append(feature)
        cs.append(cut)
        vs.append(value)
    return Trees(model.base, np.array(fs), np.array(cs), np.array(vs))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the non-decreasing least-squares fit, by pooling adjacent violators; apply with ``calibrated``."""
    if not len(y):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    s, t = score[order], y[order].astype(float)
    xs, first = np.unique(s, return_index=True)
    weight = np.diff(np.append(first, len(s))).astype(float)
    value = np.add.reduceat(t, first) / weight
    stack: list[list[float]] = []  # value, weight, lowest x, highest x
    for x, v, w in zip(xs, value, weight, strict=True):
        stack.append([v, w, x, x])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, w2, _, hi = stack.pop()
            v1, w1, lo, _ = stack.pop()
            stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    # half a row of either label keeps certain blocks off 0 and 1
    knots = [(x, (v * w + 0.5) / (w + 1)) for v, w, lo, hi in stack for x in ({lo, hi} if lo != hi else {lo})]
    knots.sort()
    return np.array([k[0] for k in knots]), np.maximum.accumulate(np.array([k[1] for k in knots]))


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.interp(score, *knots)
