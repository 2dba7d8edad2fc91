"""Cascade support-vector machines.

Row blocks are trained in parallel together with the support vectors of the last pass; their support vectors are merged in groups
of ``cascade_arity`` and trained again, until one group is left. Only support vectors leave a task. Solving is sequential minimal
optimisation over the most violating pair; several classes are solved one against one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray
from blockframe.classification.knn import accuracy
from blockframe.estimator import Estimator
from blockframe.plans.index import stack
from blockframe.plans.runtime import durable

TOLERANCE, STEPS = 1e-3, 20_000


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    if kernel == "linear":
        return a @ b.T
    d = (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)
    return np.exp(-gamma * np.maximum(d, 0))


def smo(k: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """(alpha, intercept) of a two-class machine with labels +-1."""
    n = len(y)
    alpha, grad = np.zeros(n), -np.ones(n)
    for _ in range(STEPS):
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        score = -y * grad
        i, j = int(np.where(up, score, -np.inf).argmax()), int(np.where(low, score, np.inf).argmin())
        if not up.any() or not low.any() or score[i] - score[j] < TOLERANCE:
            break
        step = (score[i] - score[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        room_i = c - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else c - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += y * step * (k[:, i] - k[:, j])
    free = (alpha > 1e-8) & (alpha < c - 1e-8)
    score = -y * grad
    if free.any():
        return alpha, float(score[free].mean())
    top, bottom = score[up].max(initial=-np.inf), score[low].min(initial=np.inf)
    ends = [v for v in (top, bottom) if np.isfinite(v)]
    return alpha, float(np.mean(ends)) if ends else 0.0


def train(x: np.ndarray, y: np.ndarray, c: float, kernel: str, gamma: float) -> tuple[np.ndarray, list]:
    """(mask of support vectors, [(class, class, y * alpha of all rows, intercept)])."""
    mask, models = np.zeros(len(x), bool), []
    for a, b in combinations(np.unique(y).tolist(), 2):
        rows = np.flatnonzero((y == a) | (y == b))
        sign = np.where(y[rows] == b, 1.0, -1.0)
        alpha, bias = smo(kernel_matrix(x[rows], x[rows], kernel, gamma), sign, c)
        weight = np.zeros(len(x))
        weight[rows] = alpha * sign
        mask |= np.abs(weight) > 1e-8
        models.append((a, b, weight, bias))
    return (mask if models else np.ones(len(x), bool)), models


class CascadeSVM(Estimator):
    """``gamma`` "auto" is 1 / n_features. The objective of the last pass decides on convergence (two classes)."""

    def __init__(
        self, cascade_arity: int = 2, max_iter: int = 5, tol: float = 1e-3, kernel: str = "rbf", c: float = 1, gamma="auto",
        check_convergence: bool = True, random_state: int | None = None, verbose: bool = False, block_rows: int | None = None,
    ):
        assert cascade_arity > 1, "cascade_arity must be above 1"
        assert max_iter > 0, "max_iter must be positive"
        assert kernel in ("rbf", "linear"), "kernel must be rbf or linear"
        assert c > 0, "c must be positive"
        assert gamma == "auto" or gamma > 0, "gamma must be auto or positive"
        self.cascade_arity, self.max_iter, self.tol, self.kernel, self.c, self.gamma = cascade_arity, max_iter, tol, kernel, c, gamma
        self.check_convergence, self.random_state, self.verbose, self.block_rows = check_convergence, random_state, verbose, block_rows
        self.support_ = self.models_ = self.classes_ = self.iterations = self.converged = None

    def fit(self, x: DsArray, y: DsArray) -> CascadeSVM:
        n, m = x.shape
        gamma = 1.0 / m if self.gamma == "auto" else float(self.gamma)
        self.gamma_ = gamma
        h = self.block_rows or min(x.block_size[0], 2000)
        c, kernel, arity = float(self.c), self.kernel, self.cascade_arity
        both = x.to_dense().df.join(y.to_dense().df.select("row_idx", F.get("features", F.lit(0)).alias("y")), "row_idx")
        blocks = -(-n // h)
        rows = durable(both.withColumn("g", F.floor(F.col("row_idx") / h)))
        schema = "row_idx bigint, features array<double>, y double, g bigint"

        def trainer(extra: pd.DataFrame | None):
            def run(p: pd.DataFrame) -> pd.DataFrame:
                if extra is not None:
                    p = pd.concat([p, extra.assign(g=p["g"].iloc[0])])
                p = p.drop_duplicates("row_idx")
                return p[train(stack(p["features"], m), p["y"].to_numpy(), c, kernel, gamma)[0]]

            return run

        held, last, self.converged = None, None, False
        for self.iterations in range(1, self.max_iter + 1):
            level, groups = rows.groupBy("g").applyInPandas(trainer(held), schema), blocks
            while groups > arity:
                groups = -(-groups // arity)
                level = level.withColumn("g", F.floor(F.col("g") / arity)).groupBy("g").applyInPandas(trainer(None), schema)
            final = level.toPandas().drop_duplicates("row_idx").sort_values("row_idx")
            v, labels = stack(final["features"], m), final["y"].to_numpy()
            mask, models = train(v, labels, c, kernel, gamma)
            held = final[mask][["row_idx", "features", "y", "g"]]
            self.support_, self.classes_ = v[mask], np.unique(labels)
            self.models_ = [(a, b, w[mask], bias) for a, b, w, bias in models]
            value = self._objective() if len(self.models_) == 1 else None
            if self.check_convergence and value is not None:
                if last is not None and abs((value - last) / (last or 1e-300)) < self.tol:
                    self.converged = True
                    break
                last = value
        return self

    def _objective(self) -> float:
        _, _, w, _ = self.models_[0]
        k = kernel_matrix(self.support_, self.support_, self.kernel, self.gamma_)
        return float(np.abs(w).sum() - 0.5 * w @ k @ w)

    def _decide(self, v: np.ndarray) -> np.ndarray:
        k = kernel_matrix(v, self.support_, self.kernel, self.gamma_)
        return np.stack([k @ w + bias for _, _, w, bias in self.models_], axis=1) if self.models_ else np.zeros((len(v), 1))

    def _apply(self, x: DsArray, f, width: int) -> DsArray:
        self._check("support_")
        m = x.shape[1]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    yield pd.DataFrame({"row_idx": p["row_idx"], "features": list(f(stack(p["features"], m)))})

        return DsArray(x.to_dense().df.mapInPandas(run, "row_idx bigint, features array<double>"), (x.shape[0], width))

    def decision_function(self, x: DsArray) -> DsArray:
        """Signed distances, one column for each pair of classes (one for two classes)."""
        return self._apply(x, self._decide, max(1, len(self.models_)))

    def predict(self, x: DsArray) -> DsArray:
        models, classes = [(a, b) for a, b, _, _ in self.models_], self.classes_

        def vote(v: np.ndarray) -> np.ndarray:
            d = self._decide(v)
            votes = np.zeros((len(v), len(classes)))
            for k, (a, b) in enumerate(models):
                votes[:, np.searchsorted(classes, a)] += d[:, k] <= 0
                votes[:, np.searchsorted(classes, b)] += d[:, k] > 0
            return classes[votes.argmax(axis=1)].astype(float)[:, None]

        return self._apply(x, vote, 1)

    def score(self, x: DsArray, y: DsArray) -> float:
        return accuracy(self.predict(x), y)
