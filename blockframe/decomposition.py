"""Principal components, and the factorizations under their estimator-side names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from blockframe.dsarray import DsArray, array
from blockframe.estimator import Estimator
from blockframe.linalg import lanczos_svd, qr, random_svd, svd, times, tsqr
from blockframe.plans.index import stack, sum_states

__all__ = ["PCA", "covariance", "lanczos_svd", "qr", "random_svd", "svd", "tsqr"]


def covariance(x: DsArray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance): two passes, the second centred, each a distributed sum of small states."""
    n, m = x.shape
    df = x.to_dense().df

    def total(parts: Iterator[pd.DataFrame]) -> np.ndarray:
        return sum((stack(p["features"], m).sum(axis=0) for p in parts), np.zeros(m))

    mean = sum_states(df, total, m) / max(n, 1)

    def scatter(parts: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros((m, m))
        for p in parts:
            c = stack(p["features"], m) - mean
            out += c.T @ c
        return out

    return mean, sum_states(df, scatter, m * m).reshape(m, m) / max(n - 1, 1)


class PCA(Estimator):
    """Principal components by eigenvectors of the covariance (``eig``, also for unknown methods) or by SVD (``svd``).

    The entry of largest size of every component is positive. ``arity`` and ``eps`` are accepted and not needed.
    """

    def __init__(self, n_components: int | None = None, arity: int = 50, method: str = "eig", eps: float = 1e-9):
        self.n_components, self.arity, self.method, self.eps = n_components, arity, method, eps
        self.components_ = self.explained_variance_ = self.mean_ = None

    def fit(self, x: DsArray, y=None) -> PCA:
        n, m = x.shape
        if self.method == "svd":
            if x.sparse:
                raise NotImplementedError("svd of sparse arrays")
            mean = np.asarray(x.mean(0).collect(squeeze=False))[0]
            _, s, v = svd(x - array(mean.reshape(1, -1)))
            values, vectors = np.asarray(s.collect(squeeze=False))[0] ** 2 / max(n - 1, 1), np.asarray(v.collect(squeeze=False)).T
        else:
            mean, cov = covariance(x)
            values, vectors = np.linalg.eigh(cov)
            values, vectors = values[::-1], vectors.T[::-1]
        k = self.n_components or m
        vectors = vectors[:k]
        sign = np.where(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)] < 0, -1.0, 1.0)
        self.components_ = array(vectors * sign[:, None])
        self.explained_variance_ = array(values[:k].reshape(1, -1))
        self.mean_ = array(mean.reshape(1, -1))
        return self

    def fit_transform(self, x: DsArray) -> DsArray:
        return self.fit(x).transform(x)

    def transform(self, x: DsArray) -> DsArray:
        self._check("components_", "mean_")
        components, mean = np.asarray(self.components_.collect(squeeze=False)), np.asarray(self.mean_.collect(squeeze=False))
        return times(x.to_dense(), components.T) - array(mean @ components.T)
