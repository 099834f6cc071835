"""Small models fitted on the driver from bounded samples, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) for which sigmoid(a*z + b) fits y, by damped Newton steps with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = float(z.std()) or 1.0
    x, beta = np.stack([z / spread, np.ones_like(z)], 1), np.array([1.0, float(np.log(pos / neg))])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * np.array([beta[0], 0]))
        beta = beta - step / max(1.0, np.abs(step).max())
    return float(max(beta[0], 1e-3) / spread), float(beta[1])


class Sparse:
    """Rows of (feature, value) pairs in three flat arrays, with the two products a linear model needs, made some rows at a time."""

    def __init__(self, feature: np.ndarray, value: np.ndarray, first: np.ndarray, dims: int, pairs: int = 1 << 18):
        self.feature, self.value, self.first, self.dims = feature, value, first, dims
        self.count = np.diff(first)
        borders = np.unique(np.searchsorted(first, np.arange(0, int(first[-1]) + pairs, pairs)))
        self.cuts = list(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)) if len(borders) > 1 else []

    def slices(self):
        """(rows, features, values, where each row's begin among them) of each part."""
        for lo, hi in self.cuts:
            hi = min(hi, len(self.count))
            a, z = self.first[lo], self.first[hi]
            yield slice(lo, hi), self.feature[a:z], self.value[a:z], self.first[lo : hi + 1] - a

    def dot(self, w: np.ndarray | None) -> np.ndarray:
        """Products of the rows with w; without w the rows' squared lengths."""
        out, w = np.zeros(len(self.count)), None if w is None else w.astype(np.float32)
        for rows, feature, value, first in self.slices():
            some = np.flatnonzero(np.diff(first))
            if len(some):
                out[rows][some] = np.add.reduceat(value * (value if w is None else w[feature]), first[some])
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dims)
        for rows, feature, value, _ in self.slices():
            out += np.bincount(feature, value * np.repeat(r[rows].astype(np.float32), self.count[rows]), self.dims)
        return out


def logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression by accelerated gradient descent."""
    row_norm = x.dot(None)
    rate = 1.0 / (0.25 * float(np.max(row_norm, initial=1.0) + 1) + l2)
    w, b = np.zeros(x.dims), 0.0
    vw, vb, t = w, b, 1.0
    weight = weight / weight.sum()
    for _ in range(steps):
        r = (sigmoid(x.dot(vw) + vb) - y) * weight
        nw, nb = vw - rate * (x.back(r) + l2 * vw), vb - rate * float(r.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


class Network:
    """A two-layer network (ReLU, then one logit) over standardised inputs, with a temperature fitted on rows set apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int, l2: float = 1e-3):
        rng = np.random.default_rng(seed)
        if not len(x):
            self.constant = 0.5
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        d = x.shape[1]
        self.p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        self.temperature, self.constant = 1.0, None
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        apart = rng.random(len(y)) < 0.2
        fit, m, v, t = np.flatnonzero(~apart), [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for i in range(0, len(fit), 128):
                k, t = fit[i : i + 128], t + 1
                for j, g in enumerate(self._gradient(x[k], y[k], l2)):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    self.p[j] = self.p[j] - 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        held = np.flatnonzero(apart)
        if len(held) > 20:
            z, grid = self._logit(x[held]), np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, -np.where(y[held] > 0, z, -z) / q)) for q in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2[0]

    def _gradient(self, x, y, l2):
        w1, b1, w2, b2 = self.p
        h = np.maximum(x @ w1 + b1, 0)
        r = (sigmoid(h @ w2 + b2[0]) - y) / len(y)
        back = np.outer(r, w2) * (h > 0)
        return [x.T @ back + l2 * w1, back.sum(0), h.T @ r + l2 * w2, np.array([r.sum()])]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self._logit(np.clip((x - self.mean) / self.scale, -8, 8)) / self.temperature)
