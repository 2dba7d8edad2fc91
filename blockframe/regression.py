"""Linear models: least squares by normal equations, and lasso by consensus ADMM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray, array
from blockframe.estimator import Estimator
from blockframe.linalg import cross, times
from blockframe.optimization import ADMM


def r2_score(predicted: DsArray, y: DsArray) -> float:
    """1 - residual / total sum of squares over all values."""
    a, b = predicted.to_dense().df, y.to_dense().df.select("row_idx", F.col("features").alias("__y"))
    v = a.join(b, "row_idx").select(F.explode(F.arrays_zip("features", "__y")).alias("e")).select(F.col("e.features").alias("p"), F.col("e.__y").alias("y"))
    row = v.agg(F.sum((F.col("y") - F.col("p")) ** 2), F.var_pop("y") * F.count("y")).first()
    return 1.0 - float(row[0]) / float(row[1]) if row[1] else 0.0


class LinearRegression(Estimator):
    """Ordinary least squares, one or several targets, in one pass over the data."""

    def __init__(self, fit_intercept: bool = True, arity: int = 50):
        self.fit_intercept, self.arity = fit_intercept, arity
        self._coef = self._intercept = None

    def fit(self, x: DsArray, y: DsArray) -> LinearRegression:
        if x.sparse or y.sparse:
            raise NotImplementedError("sparse arrays")
        m, t = x.shape[1], y.shape[1]
        one, k = [F.array(F.lit(1.0))] * bool(self.fit_intercept), m + bool(self.fit_intercept)
        both = x.df.join(y.df.select("row_idx", F.col("features").alias("y")), "row_idx").select("row_idx", F.concat(*one, "features", "y").alias("features"))
        g = cross(DsArray(both, (x.shape[0], k + t)))
        beta = np.linalg.solve(g[:k, :k], g[:k, k:])
        self._intercept = beta[:1] if self.fit_intercept else np.zeros((1, t))
        self._coef = beta[1:] if self.fit_intercept else beta
        return self

    @property
    def coef_(self) -> DsArray:
        self._check("_coef")
        return array(self._coef)

    @property
    def intercept_(self) -> DsArray:
        self._check("_intercept")
        return array(self._intercept)

    def predict(self, x: DsArray) -> DsArray:
        self._check("_coef")
        return times(x, self._coef) + array(self._intercept)

    def score(self, x: DsArray, y: DsArray) -> float:
        return r2_score(self.predict(x), y)


class Lasso(Estimator):
    """Least squares with an l1 penalty, without intercept."""

    def __init__(self, lmbd: float = 1e-3, rho: float = 1, max_iter: int = 100, atol: float = 1e-4, rtol: float = 1e-2, block_rows: int | None = None):
        self.lmbd, self.rho, self.max_iter, self.atol, self.rtol, self.block_rows = lmbd, rho, max_iter, atol, rtol, block_rows
        self.coef_ = self.n_iter_ = self.converged_ = None

    def fit(self, x: DsArray, y: DsArray) -> Lasso:
        solver = ADMM(None, self.lmbd / self.rho, self.rho, self.max_iter, self.rtol, self.atol, self.block_rows).fit(x, y)
        self.coef_, self.n_iter_, self.converged_ = solver.z_, solver.n_iter_, solver.converged_
        return self

    def predict(self, x: DsArray) -> DsArray:
        self._check("coef_")
        return times(x, np.asarray(self.coef_).reshape(-1, 1))

    def fit_predict(self, x: DsArray, y: DsArray) -> DsArray:
        return self.fit(x, y).predict(x)

    def score(self, x: DsArray, y: DsArray) -> float:
        return r2_score(self.predict(x), y)
