"""Lloyd's k-means: centres on the driver, one distributed sum of (count, sum) per centre and pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from blockframe.dsarray import DsArray
from blockframe.estimator import Estimator
from blockframe.plans.index import stack, sum_states
from blockframe.plans.runtime import reused


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, the lowest among equals."""
    d = (centres**2).sum(axis=1) - 2 * x @ centres.T
    return d.argmin(axis=1)


class KMeans(Estimator):
    """``init`` is "random" (uniform values in [0, 1)) or the centres. An empty cluster keeps its centre."""

    def __init__(self, n_clusters: int = 8, init="random", max_iter: int = 10, tol: float = 1e-4, arity: int = 50, random_state: int | None = None, verbose: bool = False):
        self.n_clusters, self.init, self.max_iter, self.tol = n_clusters, init, max_iter, tol
        self.arity, self.random_state, self.verbose = arity, random_state, verbose
        self.centers = self.n_iter = None

    def _start(self, m: int) -> np.ndarray:
        if isinstance(self.init, str):
            if self.init != "random":
                raise ValueError(f"unknown init {self.init!r}")
            return np.random.RandomState(self.random_state).random_sample((self.n_clusters, m))
        centres = np.asarray(self.init.collect(squeeze=False) if isinstance(self.init, DsArray) else self.init, float)
        if centres.shape != (self.n_clusters, m):
            raise ValueError(f"init must have the shape {(self.n_clusters, m)}")
        return centres.copy()

    def fit(self, x: DsArray, y=None) -> KMeans:
        with reused(x.to_dense().df.select("features")) as rows:
            self.centers = self._passes(rows, x.shape[1])
        return self

    def _passes(self, rows: DataFrame, m: int) -> np.ndarray:
        k, centres, old = self.n_clusters, self._start(m), None
        self.n_iter = 0
        while old is None or (self.n_iter < self.max_iter and np.sqrt(((centres - old) ** 2).sum(axis=1)).sum() >= self.tol**2):

            def state(parts: Iterator[pd.DataFrame], centres=centres) -> np.ndarray:
                out = np.zeros((k, m + 1))
                for p in parts:
                    v = stack(p["features"], m)
                    label = nearest_centre(v, centres)
                    hot = np.zeros((k, len(v)))
                    hot[label, np.arange(len(v))] = 1
                    out[:, 0] += hot.sum(axis=1)
                    out[:, 1:] += hot @ v
                return out

            sums = sum_states(rows, state, k * (m + 1)).reshape(k, m + 1)
            old, some = centres, sums[:, 0] > 0
            centres = old.copy()
            centres[some] = sums[some, 1:] / sums[some, :1]
            self.n_iter += 1
        return centres

    def fit_predict(self, x: DsArray, y=None) -> DsArray:
        return self.fit(x).predict(x)

    def predict(self, x: DsArray) -> DsArray:
        """Labels as an n x 1 array."""
        self._check("centers")
        centres, m = self.centers, x.shape[1]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    label = nearest_centre(stack(p["features"], m), centres)
                    yield pd.DataFrame({"row_idx": p["row_idx"], "features": list(label.astype(float)[:, None])})

        return DsArray(x.to_dense().df.mapInPandas(run, "row_idx bigint, features array<double>"), (x.shape[0], 1))
