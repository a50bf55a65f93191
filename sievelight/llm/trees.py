"""Gradient boosting of small regression trees for yes or no, in numpy, with calibrated probabilities.

Trees are grown level by level to a fixed depth over quantile bins of the features, on the gradients of the logistic
loss with Newton steps at the leaves. The margins are calibrated on rows that the trees haven't seen, by a logistic curve
in the margin. Ties between splits go to the first feature and the lowest cut, so fits agree between runs.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Boosted:
    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0
        self.feature = self.cut = self.leaf = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin b: cuts[b - 1] < x <= cuts[b]
        inner = 2**self.depth - 1
        self.feature, self.cut, self.leaf = np.zeros((self.rounds, inner), np.int64), np.full((self.rounds, inner), np.inf), np.zeros((self.rounds, inner + 1))
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(n, self.start)
        slot = binned + np.arange(width) * (self.bins + 1)
        for t in range(self.rounds):
            p = _sigmoid(margin)
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)  # within its level
            for d in range(self.depth):
                size = width * (self.bins + 1)
                at = (node[:, None] * size + slot).ravel()
                sums = [np.bincount(at, np.repeat(v, width), 2**d * size).reshape(2**d, width, self.bins + 1) for v in (g, h)]
                left = [np.cumsum(s, axis=2)[:, :, :-1] for s in sums]
                total = [s.sum(axis=2)[:, :1, None] for s in sums]
                right = [b - a for a, b in zip(left, total)]
                worth = left[0] ** 2 / (left[1] + self.ridge) + right[0] ** 2 / (right[1] + self.ridge) - total[0] ** 2 / (total[1] + self.ridge)
                worth[(left[1] < self.least) | (right[1] < self.least)] = 0
                flat = np.round(worth, 9).reshape(2**d, -1)
                best = flat.argmax(axis=1)
                for k in range(2**d):
                    j, b = divmod(int(best[k]), self.bins)
                    if flat[k, best[k]] > 1e-6 and b < len(cuts[j]):
                        self.feature[t, 2**d - 1 + k], self.cut[t, 2**d - 1 + k] = j, cuts[j][b]
                at = 2**d - 1 + node
                node = 2 * node + (x[np.arange(n), self.feature[t, at]] > self.cut[t, at])
            sums = [np.bincount(node, v, inner + 1) for v in (g, h)]
            self.leaf[t] = self.rate * sums[0] / (sums[1] + self.ridge)
            margin += self.leaf[t][node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, every = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> "Boosted":
        """Fits probability = sigmoid(slope * margin + shift) by Newton steps, with targets kept off 0 and 1."""
        m = self.margin(x)
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a = np.array([1.0, 0.0])
        for _ in range(steps):
            p = _sigmoid(a[0] * m + a[1])
            w = p * (1 - p) + 1e-9
            z = np.stack([m, np.ones(len(m))])
            a = a + np.linalg.solve((z * w) @ z.T + 1e-6 * np.eye(2), z @ (target - p))
        self.slope, self.shift = float(a[0]), float(a[1])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)


def lower_share(yes: float, n: float, z: float = 1.96) -> float:
    """Wilson's lower bound of a share."""
    if n == 0:
        return 0.0
    p = yes / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float | None:
    """The least probability from which on the lower bound of precision reaches ``precision``; None where it never does."""
    order = np.argsort(-p, kind="stable")
    p, right = p[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(p[1:] != p[:-1], True)) if len(p) else []
    fits = [p[i] for i in ends if lower_share(right[i], i + 1) >= precision]
    return float(min(fits)) if fits else None
