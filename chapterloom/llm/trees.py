"""Gradient-boosted regression trees for a two-class target, on quantile bins."""

from __future__ import annotations

import numpy as np

BINS = 32


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, ridge: float = 1.0,
    share: float = 0.4,
) -> dict:
    """Trees of fixed depth as arrays: the feature and the limit of each inner node, the value of each leaf.

    Each tree sees a random ``share`` of the features, so that all signs of a class get a say.
    """
    rng = np.random.default_rng(5)
    n, m = x.shape
    limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(limits[f], x[:, f], "left") for f in range(m)], 1)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    score = np.full(n, prior)
    inner = (1 << depth) - 1
    features, cuts, leaves = [], [], []
    cell = binned + np.arange(m) * BINS
    for _ in range(rounds):
        hidden = rng.permutation(m)[max(1, round(share * m)) :]
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base = (1 << level) - 1
            width = 1 << level
            at = ((node - base)[:, None] * (m * BINS) + cell).ravel()
            g = np.bincount(at, np.repeat(gradient, m), width * m * BINS).reshape(width, m, BINS).cumsum(2)
            h = np.bincount(at, np.repeat(weight, m), width * m * BINS).reshape(width, m, BINS).cumsum(2)
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[:, :, -1] = 0
            gain[:, hidden] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k, at_best in enumerate(best.tolist()):
                f, b = divmod(at_best, BINS)
                if gain[k, f, b] > 1e-9 and b < len(limits[f]):
                    feature[base + k], cut[base + k] = f, limits[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + ridge)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        leaves.append(value)
    return {"prior": prior, "depth": depth, "features": np.array(features), "cuts": np.array(cuts), "leaves": np.array(leaves)}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["prior"])
    row = np.arange(len(x))
    inner = (1 << model["depth"]) - 1
    for feature, cut, value in zip(model["features"], model["cuts"], model["leaves"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
        out += value[node - inner]
    return out
