"""Small gradient-boosted trees for binary labels, with calibrated probabilities; plain numpy."""

from __future__ import annotations

import numpy as np


def _logistic(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


class BoostedTrees:
    """Histogram trees of fixed depth under the logistic loss.

    A tree is a complete binary tree in arrays: node n has the children 2n + 1 and 2n + 2. Missing
    values are not allowed. The fit is the same on every run.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.scale, self.shift = 1.0, 0.0  # calibration

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], 1)
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        inner, self.trees = 2**self.depth - 1, []
        for _ in range(self.rounds):
            p = _logistic(score)
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            node = np.zeros(n, int)
            for at in range(inner):
                here = np.flatnonzero(node == at)
                f, b = self._split(binned[here], grad[here], hess[here], cuts)
                if f >= 0:
                    feature[at], cut[at] = f, cuts[f][b]
                node[here] = 2 * at + 1 + (x[here, feature[at]] >= cut[at])
            leaf = node - inner
            g = np.bincount(leaf, grad, inner + 1)
            h = np.bincount(leaf, hess, inner + 1)
            value = self.rate * g / (h + self.ridge)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def _split(self, binned, grad, hess, cuts) -> tuple[int, int]:
        best, gain = (-1, -1), 1e-6
        if len(grad) < 8:
            return best
        total_g, total_h = grad.sum(), hess.sum()
        whole = total_g**2 / (total_h + self.ridge)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            g = np.cumsum(np.bincount(binned[:, f], grad, len(c) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[:, f], hess, len(c) + 1))[:-1]
            gains = g**2 / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - whole
            at = int(gains.argmax())
            if gains[at] > gain:
                best, gain = (f, at), gains[at]
        return best

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration."""
        inner, out = 2**self.depth - 1, np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            out += value[node - inner]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 200) -> BoostedTrees:
        """Platt scaling on a holdout, with the usual smoothed targets."""
        s = self.score(x)
        hit, miss = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (hit + 1) / (hit + 2), 1 / (miss + 2))
        a, b = 1.0, 0.0

        def loss(a: float, b: float) -> float:
            z = a * s + b
            return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * (a - 1) ** 2 + 0.05 * b * b)

        for _ in range(rounds):  # Newton steps, halved until they gain, drawn a little towards no change of scale
            p = _logistic(a * s + b)
            w = np.maximum(p * (1 - p), 1e-9)
            normal = np.array([[(w * s * s).sum(), (w * s).sum()], [(w * s).sum(), w.sum()]]) + np.diag([1.0, 0.1])
            step = np.linalg.solve(normal, [((target - p) * s).sum() - (a - 1), (target - p).sum() - 0.1 * b])
            now, size = loss(a, b), 1.0
            while size > 1e-9 and loss(a + size * step[0], b + size * step[1]) >= now:
                size /= 2
            if size <= 1e-9:
                break
            a, b = a + size * step[0], b + size * step[1]
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.scale * self.score(x) + self.shift)
