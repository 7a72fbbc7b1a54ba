"""Gradient-boosted trees in numpy: logistic loss, features in quantile bins, trees of full levels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Trees of `depth` levels in heap order: a row of features, thresholds and leaf values for each."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.start)
        rows, width = np.arange(len(x)) * x.shape[1], x.shape[1]
        flat = np.ascontiguousarray(x, dtype=np.float32).ravel()
        assert width == x.shape[1]
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (flat.take(rows + f.take(at)) > t.take(at))
            out += leaf.take(at - (len(f)))
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 1.0, share: float = 1.0, seed: int = 3) -> Trees:
    """Second-order boosting. y: 0 or 1. share: of the rows, drawn anew for each tree."""
    n, width = x.shape
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for k in range(width)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k].astype(np.float32), side="left") for k in range(width)]).astype(np.int16)
    mean = float(y.mean())
    start = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    score = np.full(n, start)
    inner = 2**depth - 1
    fs, ts, ls = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        at = np.zeros(n, np.int64)
        drawn = np.flatnonzero(rng.random(n) < share) if share < 1 else np.arange(n)
        some, gd, hd = binned[:, drawn], g[drawn], h[drawn]
        for level in range(depth):
            first, m = 2**level - 1, 2**level
            best = np.full(m, 1e-9)
            w = bins + 1
            own = (at[drawn] - first) * w
            for k in range(width):
                if not len(cuts[k]):
                    continue
                key = own + some[k]
                gs = np.bincount(key, gd, m * w).reshape(m, w).cumsum(axis=1)
                hs = np.bincount(key, hd, m * w).reshape(m, w).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + least) + (gt - gs) ** 2 / (ht - hs + least) - gt**2 / (ht + least)
                gain = gain[:, : len(cuts[k])]
                c = gain.argmax(axis=1)
                v = gain[np.arange(m), c]
                for i in np.flatnonzero(v > best).tolist():
                    best[i], f[first + i], t[first + i] = v[i], k, cuts[k][c[i]]
            at = 2 * at + 1 + (x[np.arange(n), f[at]].astype(np.float32) > t[at])
        own = at - inner
        leaf = rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + least)
        score += leaf[own]
        fs.append(f)
        ts.append(t)
        ls.append(leaf)
    return Trees(np.array(fs), np.array(ts), np.array(ls), start, depth)
