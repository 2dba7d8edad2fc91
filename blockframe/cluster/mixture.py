"""Gaussian mixtures by expectation maximisation: parameters on the driver, one distributed sum of statistics per pass."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from blockframe.dsarray import DsArray
from blockframe.cluster.kmeans import KMeans, nearest_centre
from blockframe.estimator import Estimator
from blockframe.plans.index import stack, sum_states
from blockframe.plans.runtime import reused

TYPES = ("full", "tied", "diag", "spherical")


class ConvergenceWarning(UserWarning):
    """EM ended at max_iter."""


def precision_factor(cov: np.ndarray, kind: str) -> np.ndarray:
    """P with P P' the inverse covariance: upper triangular for full and tied, 1 / std for diag and spherical."""
    if kind in ("diag", "spherical"):
        if np.any(cov <= 0):
            raise ValueError("ill-defined empirical covariance; increase reg_covar")
        return 1 / np.sqrt(cov)
    try:
        low = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError as e:
        raise ValueError("ill-defined empirical covariance; increase reg_covar") from e
    return np.swapaxes(np.linalg.inv(low), -1, -2)


def log_prob(x: np.ndarray, weights: np.ndarray, means: np.ndarray, factor: np.ndarray, kind: str) -> np.ndarray:
    """Weighted log density of every row under every component."""
    n, d = x.shape
    out = np.empty((n, len(means)))
    for k, mu in enumerate(means):
        p = factor if kind == "tied" else factor[k]
        z = (x - mu) @ p if kind in ("full", "tied") else (x - mu) * p
        log_det = np.log(np.diag(p)).sum() if kind in ("full", "tied") else (np.log(p).sum() if kind == "diag" else d * np.log(p))
        out[:, k] = np.log(weights[k]) - 0.5 * (d * np.log(2 * np.pi) + (z**2).sum(axis=1)) + log_det
    return out


def log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


class GaussianMixture(Estimator):
    """Mixture of Gaussians with full, tied, diag or spherical covariances."""

    def __init__(
        self, n_components: int = 1, covariance_type: str = "full", check_convergence: bool = True, tol: float = 1e-3, reg_covar: float = 1e-6,
        max_iter: int = 100, init_params: str = "kmeans", weights_init=None, means_init=None, precisions_init=None, arity: int = 50,
        verbose: bool = False, random_state: int | None = None,
    ):
        self.n_components, self.covariance_type, self.check_convergence, self.tol, self.reg_covar = n_components, covariance_type, check_convergence, tol, reg_covar
        self.max_iter, self.init_params, self.weights_init, self.means_init, self.precisions_init = max_iter, init_params, weights_init, means_init, precisions_init
        self.arity, self.verbose, self.random_state = arity, verbose, random_state
        self.weights_ = self.means_ = self.covariances_ = self.precisions_cholesky_ = self.converged_ = self.n_iter = self.lower_bound_ = None

    def _validate(self, d: int) -> None:
        k = self.n_components
        for ok, what in (
            (k >= 1, "n_components must be at least 1"), (self.tol >= 0, "tol must not be negative"), (self.max_iter >= 1, "max_iter must be at least 1"),
            (self.reg_covar >= 0, "reg_covar must not be negative"), (self.covariance_type in TYPES, f"covariance_type must be one of {TYPES}"),
            (self.init_params in ("kmeans", "random"), "init_params must be kmeans or random"),
        ):
            if not ok:
                raise ValueError(what)
        if self.weights_init is not None:
            w = np.asarray(self.weights_init, float)
            if w.shape != (k,) or np.any(w < 0) or np.any(w > 1) or not np.isclose(w.sum(), 1):
                raise ValueError("weights_init must be n_components shares that sum to 1")
        if self.means_init is not None and np.asarray(self.means_init).shape != (k, d):
            raise ValueError("means_init must be n_components x n_features")
        shapes = {"full": (k, d, d), "tied": (d, d), "diag": (k, d), "spherical": (k,)}
        if self.precisions_init is not None:
            p = np.asarray(self.precisions_init, float)
            if p.shape != shapes[self.covariance_type]:
                raise ValueError("precisions_init has a wrong shape")
            if self.covariance_type in ("diag", "spherical"):
                if np.any(p <= 0):
                    raise ValueError("precisions_init must be positive")
            elif not np.allclose(p, np.swapaxes(p, -1, -2)) or np.any(np.linalg.eigvalsh(p) <= 0):
                raise ValueError("precisions_init must be symmetric and positive definite")

    def _sums(self, rows, d: int, responsibilities) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Sums over all rows of r, r x, r x x' (r x^2 for diag and spherical), and of the log density. Values are centred on the driver later."""
        k, full = self.n_components, self.covariance_type in ("full", "tied")
        width = d * d if full else d

        def state(parts: Iterator[pd.DataFrame]) -> np.ndarray:
            nk, s, ss, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, width)), 0.0
            for p in parts:
                if not len(p):
                    continue
                x = stack(p["features"], d)
                r, lp = responsibilities(x, p["row_idx"].to_numpy("int64"))
                nk += r.sum(axis=0)
                s += r.T @ x
                ss += (np.einsum("nk,ni,nj->kij", r, x, x).reshape(k, -1) if full else r.T @ x**2)
                ll += lp
            return np.concatenate([nk, s.ravel(), ss.ravel(), [ll]])

        out = sum_states(rows, state, k + k * d + k * width + 1)
        return out[:k], out[k : k + k * d].reshape(k, d), out[k + k * d : -1].reshape((k, d, d) if full else (k, d)), float(out[-1])

    def _maximise(self, n: int, nk: np.ndarray, s: np.ndarray, ss: np.ndarray) -> None:
        d = s.shape[1]
        nk = nk + 10 * np.finfo(float).eps
        self.weights_, self.means_ = nk / n, s / nk[:, None]
        mu, kind = self.means_, self.covariance_type
        if kind == "full":
            cov = ss / nk[:, None, None] - mu[:, :, None] * mu[:, None, :] + self.reg_covar * np.eye(d)
        elif kind == "tied":
            cov = (ss.sum(axis=0) - np.einsum("k,ki,kj->ij", nk, mu, mu)) / nk.sum() + self.reg_covar * np.eye(d)
        else:
            cov = ss / nk[:, None] - 2 * mu * s / nk[:, None] + mu**2 + self.reg_covar
            cov = cov.mean(axis=1) if kind == "spherical" else cov
        self.covariances_, self.precisions_cholesky_ = cov, precision_factor(cov, kind)

    def fit(self, x: DsArray, y=None) -> GaussianMixture:
        self._validate(x.shape[1])
        #: Centring keeps sums of squares small against the variances; means are moved back at the end.
        shift = np.asarray(x.mean(0).collect(squeeze=False))[0]
        with reused((x.to_dense() - shift).df) as rows:
            self._passes(rows, x, shift)
        self.means_ = self.means_ + shift
        if self.check_convergence and not self.converged_:
            warnings.warn(f"EM did not converge in {self.max_iter} passes", ConvergenceWarning, stacklevel=2)
        return self

    def _passes(self, rows: DataFrame, x: DsArray, shift: np.ndarray) -> None:
        (n, d), k, kind = x.shape, self.n_components, self.covariance_type
        seed = 0 if self.random_state is None else self.random_state
        if self.init_params == "kmeans":
            centres = KMeans(k, random_state=self.random_state).fit(x).centers - shift

            def first(v: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, float]:
                return np.eye(k)[nearest_centre(v, centres)], 0.0
        else:

            def first(v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, float]:
                r = np.array([np.random.Generator(np.random.Philox(key=[seed, int(i)])).random(k) for i in ids]).reshape(-1, k)
                return r / r.sum(axis=1, keepdims=True), 0.0

        self._maximise(n, *self._sums(rows, d, first)[:3])
        if self.weights_init is not None:
            self.weights_ = np.asarray(self.weights_init, float)
        if self.means_init is not None:
            self.means_ = np.asarray(self.means_init, float) - shift
        if self.precisions_init is not None:
            p = np.asarray(self.precisions_init, float)
            self.precisions_cholesky_ = np.linalg.cholesky(p) if kind in ("full", "tied") else np.sqrt(p)
        self.converged_, self.lower_bound_ = False, -np.inf
        for self.n_iter in range(1, self.max_iter + 1):
            parameters = (self.weights_, self.means_, self.precisions_cholesky_, kind)

            def expect(v: np.ndarray, _: np.ndarray, parameters=parameters) -> tuple[np.ndarray, float]:
                lp = log_prob(v, *parameters)
                norm = log_sum(lp)
                return np.exp(lp - norm[:, None]), float(norm.sum())

            nk, s, ss, ll = self._sums(rows, d, expect)
            self._maximise(n, nk, s, ss)
            bound, self.lower_bound_ = self.lower_bound_, ll / n
            if self.check_convergence and abs(self.lower_bound_ - bound) < self.tol:
                self.converged_ = True
                break

    def fit_predict(self, x: DsArray) -> DsArray:
        return self.fit(x).predict(x)

    def predict(self, x: DsArray) -> DsArray:
        """The most probable component of every row, n x 1."""
        self._check("weights_")
        parameters, d = (self.weights_, self.means_, self.precisions_cholesky_, self.covariance_type), x.shape[1]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    label = log_prob(stack(p["features"], d), *parameters).argmax(axis=1)
                    yield pd.DataFrame({"row_idx": p["row_idx"], "features": list(label.astype(float)[:, None])})

        return DsArray(x.to_dense().df.mapInPandas(run, "row_idx bigint, features array<double>"), (x.shape[0], 1))
