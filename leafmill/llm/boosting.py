"""Gradient-boosted trees for two classes, in numpy: histograms of binned features, log loss, Newton leaves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    bins: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of x."""
        code = np.stack([np.searchsorted(b, x[:, j], "right") for j, b in enumerate(self.bins)], 1) if len(x) else np.zeros((0, len(self.bins)), np.int64)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                f = feature[node]
                node = 2 * node + 1 + (code[rows, f] > cut[node])
            out += value[node - (len(value) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0) -> Boosted:
    """Full trees of `depth` levels; a node without a useful split passes all its rows to the left."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(b, x[:, j], "right") for j, b in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, [], float(np.log(p / (1 - p))))
    score = np.full(len(x), model.base)
    k, width = x.shape[1], bins + 1
    flat = code + np.arange(k) * width
    rows = np.arange(len(x))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * width) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, k), count * k * width).reshape(count, k, width).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
            best = gain.reshape(count, -1).argmax(1)
            useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            feature[first : first + count] = best // width
            cut[first : first + count] = np.where(useful, best % width, width)
            node = 2 * node + 1 + (code[rows, feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        score += value[leaf]
        model.trees.append((feature, cut, value))
    return model
