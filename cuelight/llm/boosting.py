"""Gradient-boosted trees, logistic regression and isotonic calibration on small dense matrices (NumPy only).

They are fitted on the driver on a matrix of features, never on texts, and sent to the executors as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logit(p: np.ndarray, edge: float = 1e-4) -> np.ndarray:
    p = np.clip(p, edge, 1 - edge)
    return np.log(p / (1 - p))


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the log-odds, stored as complete binary trees."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.15
    bins: int = 48
    ridge: float = 2.0
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        w = np.ones(len(y)) if weight is None else weight
        mean = (np.sum(w * y) + 0.5) / (np.sum(w) + 1)
        self.base = float(np.log(mean / (1 - mean)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        code = np.stack([np.searchsorted(c, v, side="left").astype(np.min_scalar_type(self.bins)) for c, v in zip(cuts, x.T, strict=True)]) if len(y) else np.zeros((x.shape[1], 0), int)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            p = sigmoid(f)
            g, h = w * (y - p), w * p * (1 - p)
            node, feature, cut = np.zeros(len(y), int), np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k, n = code[j] + (len(c) + 1) * node, width * (len(c) + 1)
                    gl = np.bincount(k, g, n).reshape(width, -1).cumsum(1)
                    hl = np.bincount(k, h, n).reshape(width, -1).cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                    at = gain[:, :-1].argmax(1)
                    value = gain[np.arange(width), at]
                    better = value > best
                    best[better], feature[first : first + width][better], cut[first : first + width][better] = value[better], j, c[at[better]]
                right = x[np.arange(len(y)), feature[first + node]] > cut[first + node]
                node = 2 * node + right
            n = 2**self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge)
            f = f + leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, at = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = 2 * node + (x[at, feature[k]] > cut[k])
            f += leaf[node]
        return f

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    ridge: float = 1.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        w = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        a, beta = self._design(x), np.zeros(x.shape[1] + 1)
        for _ in range(25):
            p = sigmoid(a @ beta)
            penalty = np.full(len(beta), self.ridge)
            penalty[0] = 1e-3
            step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (w * (y - p)) - penalty * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = beta
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._design(x) @ self.weights)


@dataclass
class Isotonic:
    """Monotone map from scores to probabilities by pooling adjacent violators, linear between the pools' centres."""

    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def fit(self, score: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
        if not len(y):
            self.at, self.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
            return self
        rate = float(np.mean(y))
        pools: list[list[float]] = []
        for s, t in sorted(zip(score.tolist(), y.tolist(), strict=True)):
            pools.append([t, 1.0, s])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                t2, n2, s2 = pools.pop()
                t1, n1, s1 = pools[-1]
                pools[-1] = [t1 + t2, n1 + n2, s1 + s2]
        self.at = np.array([s / n for _, n, s in pools])
        self.value = np.maximum.accumulate([(t + prior * rate) / (n + prior) for t, n, _ in pools])
        return self

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)
