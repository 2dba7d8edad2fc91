"""Density clustering by regions with halos.

Space is cut into regions of several eps in a few dimensions; every row also visits the regions within 2 eps of it, so each region
knows all neighbours of its own rows and of those near it, and decides cores exactly on its own. Core components of the
regions are joined through the rows they share. The result does not depend on the regions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray
from blockframe.estimator import Estimator
from blockframe.operators.proximity import CHUNK, squared
from blockframe.plans.graph import components, contract
from blockframe.plans.index import stack
from blockframe.plans.runtime import durable

#: Edge of a region in eps, where n_regions does not say otherwise.
REGION = 8


def _region_labels(x: np.ndarray, ids: np.ndarray, eps: float, min_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core, local label as a row id, row id of the nearest core or -1) of all rows in a region."""
    n, step, within = len(x), max(1, CHUNK // max(1, len(x))), eps * eps * (1 + 1e-12)
    count = np.zeros(n, int)
    for at in range(0, n, step):
        count[at : at + step] = (squared(x[at : at + step], x) <= within).sum(axis=1)
    core = count >= min_samples
    where = np.flatnonzero(core)
    label, nearest = np.arange(n), np.full(n, -1, np.int64)
    if len(where):
        label_of = np.arange(len(where))
        for at in range(0, n, step):
            d = squared(x[at : at + step], x[where])
            d[d > within] = np.inf
            best = np.lexsort((np.broadcast_to(ids[where], d.shape), d), axis=1)[:, 0] if d.shape[1] < 64 else d.argmin(axis=1)
            found = np.isfinite(d[np.arange(len(d)), best])
            nearest[at : at + step][found] = ids[where][best[found]]
            rows = np.flatnonzero(core[at : at + step])
            i, j = np.nonzero(np.isfinite(d[rows]))
            own = np.searchsorted(where, rows[i] + at)
            label_of = components(np.concatenate([np.arange(len(where)), own]), np.concatenate([label_of, j]), len(where))
        label[where] = where[label_of]
    return core, ids[label], nearest


class DBSCAN(Estimator):
    """Rows with at least ``min_samples`` rows (themselves included) within ``eps`` are cores; cores within eps share a cluster; other
    rows within eps of a core join the nearest one; the rest is noise (-1). Labels count clusters by their smallest core row.

    ``n_regions`` and ``dimensions`` shape the regions; ``max_samples`` is accepted and not needed.
    """

    transient = ("_labels",)

    def __init__(self, eps: float = 0.5, min_samples: int = 5, n_regions: int = 1, dimensions: list[int] | None = None, max_samples: int | None = None):
        if n_regions < 1:
            raise ValueError("n_regions must be positive")
        self.eps, self.min_samples, self.n_regions, self.dimensions, self.max_samples = eps, min_samples, n_regions, dimensions, max_samples
        self.n_clusters_, self._labels = None, None

    def fit(self, x: DsArray, y=None) -> DBSCAN:
        dense, m = x.to_dense(), x.shape[1]
        eps, least = float(self.eps), int(self.min_samples)
        dims = list(self.dimensions if self.dimensions is not None else range(m))[:3]
        low, high = (np.atleast_1d(np.asarray(f(0).collect())) for f in (dense.min, dense.max))
        cells = dense.df.withColumn("home", F.lit(True))
        keys = []
        for d in dims:
            span = float(high[d] - low[d])
            width = max(span / self.n_regions * (1 + 1e-9) if self.n_regions > 1 else REGION * eps, 2 * eps, 1e-300)
            v, last = F.get("features", F.lit(d)) - F.lit(float(low[d])), max(0, math.ceil(span / width) - 1)
            own = F.least(F.floor(v / width), F.lit(last)).cast("int")
            reach = F.sequence(F.greatest(F.floor((v - 2 * eps) / width), F.lit(0)).cast("int"), F.least(F.floor((v + 2 * eps) / width), F.lit(last)).cast("int"))
            cells = cells.withColumn(f"own{d}", own).withColumn(f"c{d}", F.explode(F.array_union(F.array(own), reach)))
            cells = cells.withColumn("home", F.col("home") & (F.col(f"c{d}") == F.col(f"own{d}")))
            keys.append(f"c{d}")

        def region(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("row_idx")
            ids = part["row_idx"].to_numpy("int64")
            core, label, nearest = _region_labels(stack(part["features"], m), ids, eps, least)
            return pd.DataFrame({"row_idx": ids, "home": part["home"].to_numpy(bool), "core": core, "label": label, "nearest": nearest})

        found = durable(cells.select(*keys, "row_idx", "features", "home").groupBy(*keys).applyInPandas(region, "row_idx bigint, home boolean, core boolean, label bigint, nearest bigint"))
        #: At a region's margin a visitor may look like no core; its own region decides.
        cores = durable(found.filter("home AND core").select("row_idx"))
        seen = found.filter("core").join(cores, "row_idx", "left_semi").groupBy("row_idx").agg(F.min("label").alias("u"), F.collect_set("label").alias("all"))
        seen = durable(seen)
        roots = contract(seen.select("u", F.explode("all").alias("v")))
        cluster = seen.join(roots, seen["u"] == roots["node"], "left").select("row_idx", F.coalesce("root", "u").alias("root"))
        cluster = durable(cluster)
        names = cluster.groupBy("root").agg(F.min("row_idx").alias("first"))
        from blockframe.plans.index import dense_index

        names = dense_index(names, ["first"], "name")
        self.n_clusters_ = names.count()
        of_core = cluster.join(names, "root").select(F.col("row_idx").alias("nearest"), "name")
        border = found.filter("home").select("row_idx", "nearest")
        labels = border.join(of_core, "nearest", "left").select("row_idx", F.array(F.coalesce("name", F.lit(-1)).cast("double")).alias("features"))
        self._labels = DsArray(durable(labels), (x.shape[0], 1))
        return self

    @property
    def n_clusters(self) -> int:
        self._check("n_clusters_")
        return self.n_clusters_

    def fit_predict(self, x: DsArray) -> DsArray:
        """Labels, n x 1."""
        return self.fit(x)._labels
