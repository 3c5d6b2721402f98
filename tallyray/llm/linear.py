"""Logistic regression on a bounded sample of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Logistic:
    """Standardised features, weights and bias."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, penalty: float = 1.0, steps: int = 40) -> Logistic:
    """Weighted ridge logistic regression by damped Newton steps.

    Without rows of both classes every score is the (smoothed) share of ones.
    """
    n, k = x.shape
    w = np.ones(n) if w is None else w
    share = (float(w @ y) + 0.01) / (float(w.sum()) + 1.0)
    prior = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Logistic(np.zeros(k), np.ones(k), np.zeros(k), prior)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((n, 1))])
    ridge = np.full(k + 1, penalty)
    ridge[-1] = 1e-6
    beta = np.zeros(k + 1)
    beta[-1] = prior

    def loss(b: np.ndarray) -> float:
        m = z @ b
        return float(w @ (np.logaddexp(0, m) - y * m)) + 0.5 * float(ridge @ (b * b))

    now = loss(beta)
    for _ in range(steps):
        p = sigmoid(z @ beta)
        step = np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag(ridge), z.T @ (w * (p - y)) + ridge * beta)
        size = 1.0
        while size > 1e-4 and (then := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-7 * max(1.0, now):
            break
        beta, now = beta - size * step, then
    return Logistic(mean, scale, beta[:-1], float(beta[-1]))


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32(doc_id as text) mod 4 is 2. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def at_most(df: DataFrame, rows: int, key: Column, seed: int) -> DataFrame:
    """About ``rows`` rows of ``df``, the same ones in every run, or all if there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
