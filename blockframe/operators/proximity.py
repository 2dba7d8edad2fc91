"""Nearest neighbours and radius joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray, session
from blockframe.estimator import Estimator
from blockframe.linalg import BROADCAST_VALUES
from blockframe.plans.index import dense_index, stack

#: Distances that a task holds at once.
CHUNK = 2_000_000
#: Dimensions of the grid of a radius join.
GRID = 3


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, each a sum of squared differences."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += np.subtract.outer(q[:, j], x[:, j]) ** 2
    return out


def _smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each row with their ids, equal ones by id."""
    if d.shape[1] > k:
        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        width = int((d <= bound).sum(axis=1).max())
        at = np.argpartition(d, min(width, d.shape[1]) - 1, axis=1)[:, :width]
        d, ids = np.take_along_axis(d, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def top_k(fit: DataFrame, queries: DataFrame, k: int, m: int) -> DataFrame:
    """(q, idx, d2, rank): the k nearest rows of ``fit`` (row_idx, features) of each of ``queries``, equal distances by smaller row.

    Queries go in blocks small enough to broadcast, whatever their row numbers; each block meets every partition of ``fit`` once, and a partition
    sends k rows for each query, since it keeps the best so far over its batches.
    """
    block, spark = max(1, BROADCAST_VALUES // max(m, 4 * k)), session()
    total = queries.count()
    if total > block:
        numbered = dense_index(queries.select("row_idx", "features"), ["row_idx"], "place")
        pages = [numbered.filter((F.col("place") >= begin) & (F.col("place") < begin + block)) for begin in range(0, total, block)]
    else:
        pages = [queries]
    found = None
    for page in pages:
        rows = page.select("row_idx", "features").toPandas()
        shared = spark.sparkContext.broadcast((rows["row_idx"].to_numpy("int64"), stack(rows["features"], m)))

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
            for p in parts:
                x, own = stack(p["features"], m), p["row_idx"].to_numpy("int64")
                step = max(1, CHUNK // max(1, len(x)))
                for at in range(0, len(q) if len(x) else 0, step):
                    here = slice(at, at + step)
                    d = np.hstack([best_d[here], squared(q[here], x)])
                    i = np.hstack([best_i[here], np.broadcast_to(own, (len(d), len(own)))])
                    best_d[here], best_i[here] = _smallest(d, i, k)
            some = np.isfinite(best_d.ravel())
            yield pd.DataFrame({"q": np.repeat(ids, k)[some], "idx": best_i.ravel()[some], "d2": best_d.ravel()[some]})

        part = fit.select("row_idx", "features").mapInPandas(run, "q bigint, idx bigint, d2 double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d2", "idx"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class NearestNeighbors(Estimator):
    """Exact Euclidean nearest neighbours; equal distances by smaller row."""

    transient = ("_fit",)

    def __init__(self, n_neighbors: int = 5):
        self.n_neighbors = n_neighbors
        self._fit = None

    def fit(self, x: DsArray, y=None) -> NearestNeighbors:
        self._fit = x.to_dense()
        return self

    def pairs(self, q: DsArray, n_neighbors: int | None = None) -> DataFrame:
        """(q, idx, d2, rank)."""
        self._check("_fit")
        return top_k(self._fit.df, q.to_dense().df, n_neighbors or self.n_neighbors, q.shape[1])

    def kneighbors(self, q: DsArray, n_neighbors: int | None = None, return_distance: bool = True):
        """(distances, indices) arrays of n_queries x k, or the indices alone."""
        k = min(n_neighbors or self.n_neighbors, self._fit.shape[0])
        rows = self.pairs(q, k).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "idx", "d2"))).alias("e"))
        indices = DsArray(rows.select(F.col("q").alias("row_idx"), F.transform("e", lambda e: e["idx"].cast("double")).alias("features")), (q.shape[0], k))
        if not return_distance:
            return indices
        return DsArray(rows.select(F.col("q").alias("row_idx"), F.transform("e", lambda e: F.sqrt(e["d2"])).alias("features")), (q.shape[0], k)), indices


def pairwise_distances(a: DsArray, b: DsArray) -> DsArray:
    """Euclidean distances of the rows of ``a`` to all rows of ``b``, which must be small enough to broadcast."""
    if b.shape[0] * b.shape[1] > BROADCAST_VALUES:
        raise ValueError(f"{b.shape} is too large to broadcast")
    m, shared = a.shape[1], session().sparkContext.broadcast(b.collect(squeeze=False))
    step = max(1, CHUNK // max(1, b.shape[0]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), step):
                part = p.iloc[at : at + step]
                yield pd.DataFrame({"row_idx": part["row_idx"], "features": list(np.sqrt(squared(stack(part["features"], m), shared.value)))})

    return DsArray(a.to_dense().df.mapInPandas(run, "row_idx bigint, features array<double>"), (a.shape[0], b.shape[0]))


def range_join(a: DataFrame, b: DataFrame, eps: float, dimensions: list[int] | None = None) -> DataFrame:
    """(i, j, d): rows i of ``a`` and j of ``b`` (row_idx, features) at most ``eps`` apart.

    An equality join on grid cells of edge ``eps`` in at most ``GRID`` dimensions (each row of ``b`` in its cell and the neighbouring ones),
    then the distance itself; no cartesian product.
    """
    dims = list(dimensions if dimensions is not None else range(GRID))[:GRID]
    width = float(eps) * (1 + 1e-9) if eps > 0 else 1e-300  # rounding must not put rows eps apart two cells apart

    def cells(df: DataFrame, prefix: str, around: tuple[int, ...]) -> DataFrame:
        home = [F.floor(F.coalesce(F.get("features", F.lit(d)), F.lit(0.0)) / width) for d in dims]
        keys = [F.xxhash64(*[h + s for h, s in zip(home, shift, strict=True)]) for shift in product(around, repeat=len(dims))]
        return df.select(F.col("row_idx").alias(prefix), F.col("features").alias(f"x{prefix}"), F.explode(F.array_distinct(F.array(*keys))).alias("cell"))

    near = cells(a, "i", (0,)).join(cells(b, "j", (-1, 0, 1)), "cell")
    d2 = F.aggregate(F.zip_with("xi", "xj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return near.select("i", "j", F.sqrt(d2).alias("d")).filter(F.col("d") <= eps)
