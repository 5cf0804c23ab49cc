"""Support vectors by sequential minimal optimisation, with probabilities from cross-validated margins."""

from __future__ import annotations

import numpy as np


def smo(k: np.ndarray, s: np.ndarray, top: np.ndarray, tol: float = 1e-6, most: int = 100_000) -> tuple[np.ndarray, float]:
    """(alpha, bias) of the dual: least alpha'Qa/2 - sum(alpha), 0 <= alpha <= top, sum(alpha s) = 0, with Q = s s' k.

    Each step solves for two multipliers: the one that most violates the optimality conditions, and of those that
    violate them with it the one whose step promises most.
    """
    n = len(s)
    alpha, grad = np.zeros(n), -np.ones(n)
    diag = np.diag(k)
    for _ in range(most):
        up = ((s > 0) & (alpha < top)) | ((s < 0) & (alpha > 0))
        low = ((s > 0) & (alpha > 0)) | ((s < 0) & (alpha < top))
        if not up.any() or not low.any():
            break
        score = -s * grad
        i = int(np.argmax(np.where(up, score, -np.inf)))
        gap = score[i] - score
        if gap[low].max() < tol:
            break
        curve = np.maximum(diag[i] + diag - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (gap > 0), gap * gap / curve, -np.inf)))
        step = gap[j] / curve[j]
        # Along the pair alpha_i grows with s_i, alpha_j falls with s_j, as far as both boxes allow.
        step = min(step, top[i] - alpha[i] if s[i] > 0 else alpha[i], alpha[j] if s[j] > 0 else top[j] - alpha[j])
        alpha[i] += s[i] * step
        alpha[j] -= s[j] * step
        for m in (i, j):
            alpha[m] = 0.0 if alpha[m] < 1e-14 else top[m] if top[m] - alpha[m] < 1e-14 else alpha[m]
        grad += s * (k[:, i] - k[:, j]) * step
    score = -s * grad
    free = (alpha > 0) & (alpha < top)
    if free.any():
        return alpha, float(score[free].mean())
    up = ((s > 0) & (alpha < top)) | ((s < 0) & (alpha > 0))
    highest, lowest = (score[up].max() if up.any() else None), (score[~up].min() if (~up).any() else None)
    return alpha, float(np.mean([v for v in (highest, lowest) if v is not None]))


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of P(y = 1) = 1 / (1 + exp(a margin + b)) with smoothed targets (Newton's method with halved steps)."""
    n1, n0 = float((y == 1).sum()), float((y != 1).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        f = a * margin + b
        return float((np.logaddexp(0, -np.abs(f)) + np.where(f >= 0, t * f, (t - 1) * f)).sum())

    a, b = 0.0, float(np.log((n0 + 1) / (n1 + 1)))
    value = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(a * margin + b, -700, 700)))
        d1, d2 = t - p, p * (1 - p)
        g = np.array([(margin * d1).sum(), d1.sum()])
        if np.abs(g).max() < 1e-9:
            break
        h = np.array([[(margin * margin * d2).sum() + 1e-12, (margin * d2).sum()], [(margin * d2).sum(), d2.sum() + 1e-12]])
        step, size = -np.linalg.solve(h, g), 1.0
        while size > 1e-10 and (new := loss(a + size * step[0], b + size * step[1])) > value + 1e-4 * size * (g @ step):
            size /= 2
        if size <= 1e-10:
            break
        a, b, value = a + size * step[0], b + size * step[1], new
    return a, b


class SupportVectors:
    """RBF support vectors with balanced classes; gamma is 1 / (columns x variance).

    The call gives probabilities by a sigmoid of the margin, fitted to margins of `folds` inner folds; decide() is the
    side of the margin, which need not agree with them.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, c: float = 1.0, folds: int = 5, seed: int = 42) -> None:
        n = np.bincount(y, minlength=2).astype(float)
        var = x.var()
        self.gamma = 1 / (x.shape[1] * var) if var > 0 else 1.0
        self.top = c * (len(y) / (2 * np.maximum(n, 1)))
        self.x, self.weights, self.bias = self._fit(x, y)
        margin = np.zeros(len(y))
        order = np.random.default_rng(seed).permutation(len(y))
        for part in np.array_split(order, min(folds, len(y))):
            rest = np.setdiff1d(order, part)
            margin[part] = self._margin(x[part], *self._fit(x[rest], y[rest]))
        self.a, self.b = sigmoid_fit(margin, y)

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))

    def _fit(self, x: np.ndarray, y: np.ndarray):
        """Vectors, their weights and the bias; a single class has a margin of 1 on its side, none has 0."""
        if len(set(y.tolist())) < 2:
            return x[:0], np.zeros(0), 0.0 if not len(y) else float(2 * y[0] - 1)
        s = 2.0 * y - 1
        alpha, bias = smo(self.kernel(x, x), s, self.top[y])
        held = alpha > 0
        return x[held], (alpha * s)[held], bias

    def _margin(self, v: np.ndarray, x: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        return (self.kernel(v, x) @ weights if len(x) else np.zeros(len(v))) + bias

    def decide(self, v: np.ndarray) -> np.ndarray:
        return self._margin(v, self.x, self.weights, self.bias) > 0

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.a * self._margin(v, self.x, self.weights, self.bias) + self.b, -700, 700)))
