"""Consensus ADMM over row blocks.

The state of a block is its w and u vectors, kept in a checkpointed table with the block's Gram matrix; the consensus z is one vector
on the driver. For least squares, the default, a block's update is a small solve; any other loss comes as a function that solves
its proximal step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray
from blockframe.estimator import Estimator
from blockframe.plans.index import stack
from blockframe.plans.runtime import durable


def soft_threshold(v: np.ndarray, k: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - k, 0)


class ADMM(Estimator):
    """``loss_fn(x, y, v, rho)`` returns the w that minimises the block's loss + rho / 2 |w - v|^2; None means 1/2 |x w - y|^2.

    ``block_rows`` (default: the block hint) sets the blocks, whose number matters for the result.
    """

    def __init__(self, loss_fn: Callable | None = None, k: float = 1e-3, rho: float = 1, max_iter: int = 100, rtol: float = 1e-2, atol: float = 1e-4, block_rows: int | None = None):
        self.loss_fn, self.k, self.rho, self.max_iter, self.rtol, self.atol, self.block_rows = loss_fn, k, rho, max_iter, rtol, atol, block_rows
        self.z_ = self.n_iter_ = self.converged_ = None

    def fit(self, x: DsArray, y: DsArray) -> ADMM:
        n, d = x.shape
        h, rho, loss = self.block_rows or x.block_size[0], float(self.rho), self.loss_fn
        both = x.to_dense().df.join(y.to_dense().df.select("row_idx", F.get("features", F.lit(0)).alias("y")), "row_idx")
        blocks = both.withColumn("b", F.floor(F.col("row_idx") / h))

        def prepare(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("row_idx")
            v, t = stack(p["features"], d), p["y"].to_numpy(float)
            data = [np.linalg.inv(v.T @ v + rho * np.eye(d)).ravel(), v.T @ t] if loss is None else [v.ravel(), t]
            return pd.DataFrame({"b": [int(key[0])], "a": [data[0]], "c": [data[1]], "w": [np.zeros(d)], "u": [np.zeros(d)]})

        schema = "b bigint, a array<double>, c array<double>, w array<double>, u array<double>"
        state = durable(blocks.groupBy("b").applyInPandas(prepare, schema))
        parts = state.count()
        z, u2 = np.zeros(d), 0.0
        for self.n_iter_ in range(1, self.max_iter + 1):

            def update(part: pd.DataFrame, z=z, first=self.n_iter_ == 1) -> pd.DataFrame:
                """The dual step of the pass before and the primal step of this one, in one go."""
                ws, us = [], []
                for a, c, w, u in zip(part["a"], part["c"], part["w"], part["u"], strict=True):
                    u = np.asarray(u) if first else np.asarray(u) + np.asarray(w) - z
                    v = z - u
                    if loss is None:
                        ws.append(np.asarray(a).reshape(d, d) @ (np.asarray(c) + rho * v))
                    else:
                        ws.append(np.asarray(loss(np.asarray(a).reshape(-1, d), np.asarray(c), v, rho), float))
                    us.append(u)
                return part.assign(w=ws, u=us)

            state = durable(state.mapInPandas(lambda it, f=update: (f(p) for p in it if len(p)), schema))
            mean_w, mean_u = self._means(state, parts)
            old, z = z, soft_threshold(mean_w + mean_u, self.k)
            less = lambda c, v: F.zip_with(c, F.lit(v.tolist()), lambda x, y: x - y)
            square = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
            dual = less(F.zip_with("u", "w", lambda x, y: x + y), z)
            r2, w2, u2 = state.agg(square(less("w", z)), square(F.col("w")), square(dual)).first()
            s = np.sqrt(parts) * rho * np.linalg.norm(z - old)
            eps = np.sqrt(parts * d) * self.atol
            primal = eps + self.rtol * max(np.sqrt(w2), np.sqrt(parts) * np.linalg.norm(z))
            self.converged_ = bool(np.sqrt(r2) <= primal and s <= eps + self.rtol * rho * np.sqrt(u2))
            if self.converged_:
                break
        self.z_ = z
        return self

    @staticmethod
    def _means(state: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Means of w and u over the blocks."""
        cells = state.select(F.posexplode(F.arrays_zip("w", "u")).alias("j", "e")).groupBy("j").agg(F.sum("e.w").alias("w"), F.sum("e.u").alias("u"))
        rows = cells.orderBy("j").collect()
        return np.array([r["w"] for r in rows], float) / parts, np.array([r["u"] for r in rows], float) / parts
