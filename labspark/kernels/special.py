"""Special functions, quantiles and random designs that neither Spark nor numpy has."""

from __future__ import annotations

import math

import numpy as np


def chi2_survival(x: float, df: int) -> float:
    """Upper tail of chi-square by the incomplete gamma function: series below a + 1, continued fraction above."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * front)
    tiny, b = 1e-300, z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, front * h)


def normal_two_sided(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) if z > 0 else 1.0


def normal_quantile(p: np.ndarray | float) -> np.ndarray:
    """Standard normal quantiles by Newton steps on the error function from a rational start."""
    p = np.atleast_1d(np.asarray(p, float))
    out = np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, 0.0))
    inside = (p > 0) & (p < 1)
    q = np.minimum(p[inside], 1 - p[inside])
    t = np.sqrt(-2 * np.log(q))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    for _ in range(4):
        tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in x])
        slope = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        step = (tail - q) / slope
        x = x + step / (1 - x * step / 2)
    out[inside] = np.where(p[inside] < 0.5, -x, x)
    return out


def cholesky(matrix: np.ndarray) -> np.ndarray | None:
    """Lower factor, or None where the matrix is not positive definite."""
    try:
        return np.linalg.cholesky(np.asarray(matrix, float))
    except np.linalg.LinAlgError:
        return None


def latin_hypercube(n: int, dims: int, rng: np.random.Generator) -> np.ndarray:
    """One draw in each of n strata of every dimension, in independent orders."""
    return (np.argsort(rng.random((n, dims)), axis=0) + rng.random((n, dims))) / n


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    ranks = [np.argsort(np.argsort(v)) for v in (a, b)]
    return float(np.corrcoef(*ranks)[0, 1])


def iman_conover(sample: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The columns of sample reordered so that their rank correlation is near target."""
    n, k = sample.shape
    scores = normal_quantile((np.arange(1, n + 1)) / (n + 1))
    m = np.column_stack([rng.permutation(scores) for _ in range(k)])
    own, want = cholesky(np.corrcoef(m, rowvar=False)), cholesky(target)
    if own is None or want is None:
        raise ValueError("correlations must be positive definite")
    lead = m @ np.linalg.inv(own).T @ want.T
    return np.column_stack([np.sort(sample[:, j])[np.argsort(np.argsort(lead[:, j]))] for j in range(k)])
