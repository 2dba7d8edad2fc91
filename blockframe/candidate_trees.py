"""Trees grown level by level from candidate splits of every node.

A level takes two passes over the rows for all open nodes of all trees together: one finds each node's candidate thresholds (quantiles, or those of a
normal or a uniform distribution with the node's moments), one sums the labels by (tree, node, feature, bin). Only thresholds and sums
reach the driver, in chunks of at most ``CHUNK_VALUES`` values. Rows stay where they are: their node follows from the trees grown so far, which
are broadcast, and their weight in a tree from a hash of the row number.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.dsarray import session
from blockframe.plans.index import stack, sum_states
from blockframe.plans.runtime import reused

#: Values summed for a chunk of nodes, and nodes of all trees beyond which growth stops with a warning.
CHUNK_VALUES, MOST_NODES = 4_000_000, 1_000_000
#: Rows that either side of a split must have, and up to which a node is a leaf (fixed values).
LEAST_SIDE, LEAF_ROWS = 4, 4
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass
class Tree:
    """Node arrays: ``feature`` -1 is a leaf; ``value`` has class shares or a mean."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [None])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node that every row has come to."""
        feature, threshold, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])


def weights(rows: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often each row stands in the sample of a tree: Poisson numbers of a hash."""
    if not bootstrap:
        return np.ones(len(rows))
    z = rows.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = (z ^ (z >> np.uint64(31))).astype(float) / 2.0**64
    return np.searchsorted(_POISSON, u).astype(float)


def thresholds(open_rows: DataFrame, kind: str, points: int, low: float | None, high: float | None) -> dict[tuple[int, int, int], np.ndarray]:
    """Candidate thresholds of every (tree, node, feature) of rows (tree, node, w, features)."""
    cells = open_rows.select("tree", "node", F.posexplode("features").alias("j", "v"))
    if kind == "raw":
        made = [F.percentile_approx("v", [(i + 1) / (points + 1) for i in range(points)], 1000).alias("a")]
    elif kind == "gaussian_approximation":
        made = [F.array(F.avg("v"), F.stddev_pop("v")).alias("a")]
    else:
        made = [F.array(F.min("v") if low is None else F.lit(float(low)), F.max("v") if high is None else F.lit(float(high))).alias("a")]
    out = {}
    shares = (np.arange(points) + 1) / (points + 1)
    normal = np.array([NormalDist().inv_cdf(s) for s in shares])
    for r in cells.groupBy("tree", "node", "j").agg(*made).collect():
        a = np.array(r["a"], float)
        t = a if kind == "raw" else (a[0] + a[1] * normal if kind == "gaussian_approximation" else a[0] + (a[1] - a[0]) * shares)
        out[r["tree"], r["node"], r["j"]] = np.unique(t)
    return out


def grow(rows: DataFrame, m: int, classes: int, trees: int, depth: float, tried: int, points: int, kind: str, low, high, bootstrap: bool, seed: int) -> list[Tree]:
    """``trees`` trees of rows (row_idx, features, y); y is a class number, or with ``classes`` 0 a value."""
    forest = [Tree() for _ in range(trees)]
    width = classes or 3
    open_nodes, level = [(t, 0) for t in range(trees)], 0
    with reused(rows) as kept:
        while open_nodes and level <= depth:
            size, following = max(1, CHUNK_VALUES // (m * (points + 1) * width)), []
            for begin in range(0, len(open_nodes), size):
                following += _split(kept, forest, open_nodes[begin : begin + size], m, classes, level < depth, tried, points, kind, low, high, bootstrap, seed)
            open_nodes, level = following, level + 1
            if sum(len(t.feature) for t in forest) > MOST_NODES:
                warnings.warn(f"trees of {MOST_NODES} nodes are left as they are; set max_depth", stacklevel=2)
                break
    return forest


def _split(rows, forest, nodes, m, classes, deeper, tried, points, kind, low, high, bootstrap, seed) -> list[tuple[int, int]]:
    """Give the nodes their values, split those that can be, and return the new nodes."""
    shared, wanted = session().sparkContext.broadcast(forest), {}
    for t, node in nodes:
        wanted.setdefault(t, []).append(node)

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(tree, node, w, features, y): rows of the open nodes, as often as trees hold them."""
        for p in parts:
            if not len(p):
                continue
            x, ids = stack(p["features"], m), p["row_idx"].to_numpy("int64")
            for t, own in wanted.items():
                w, at = weights(ids, t, seed, bootstrap), shared.value[t].place(x)
                here = np.flatnonzero((w > 0) & np.isin(at, own))
                if len(here):
                    yield pd.DataFrame({"tree": t, "node": at[here], "w": w[here], "features": p["features"].to_numpy()[here], "y": p["y"].to_numpy()[here]})

    open_rows = rows.mapInPandas(opened, "tree int, node bigint, w double, features array<double>, y double")
    cuts = thresholds(open_rows, kind, points, low, high) if deeper else {}
    place, width = {tn: i for i, tn in enumerate(nodes)}, classes or 3
    shape = (len(nodes), m, points + 1, width)
    grid = session().sparkContext.broadcast(cuts)

    def state(parts: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros(shape)
        for p in parts:
            for (t, node), q in p.groupby(["tree", "node"]):
                x, w, y = stack(q["features"], m), q["w"].to_numpy(), q["y"].to_numpy()
                for j in range(m):
                    bins = np.searchsorted(grid.value.get((t, node, j), np.zeros(0)), x[:, j], side="left")
                    if classes:
                        np.add.at(out[place[t, node], j], (bins, y.astype(int)), w)
                    else:
                        for k, v in enumerate((w, w * y, w * y * y)):
                            out[place[t, node], j, :, k] += np.bincount(bins, v, points + 1)
        return out

    sums = sum_states(open_rows, state, int(np.prod(shape))).reshape(shape)
    new = []
    for (t, node), s in zip(nodes, sums, strict=True):
        tree, total = forest[t], s[0].sum(axis=0)
        n = total.sum() if classes else total[0]
        tree.value[node] = total / max(n, 1e-300) if classes else np.array([total[1] / max(n, 1e-300)])
        pure = (total > 0).sum() <= 1 if classes else total[2] - total[1] ** 2 / max(n, 1e-300) <= 1e-12 * max(total[2], 1e-300)
        if not deeper or n <= LEAF_ROWS or pure:
            continue
        order = np.random.default_rng([seed, t, node]).permutation(m)
        best = None
        for count, j in enumerate(order):
            if count >= tried and best is not None:
                break
            left = np.cumsum(s[j], axis=0)[:-1][: len(cuts.get((t, node, j), ()))]
            if not len(left):
                continue
            right = total - left
            nl, nr = (left.sum(axis=1), right.sum(axis=1)) if classes else (left[:, 0], right[:, 0])
            a, b = ((left**2).sum(axis=1), (right**2).sum(axis=1)) if classes else (left[:, 1] ** 2, right[:, 1] ** 2)
            least = LEAST_SIDE if classes else 1
            gain = np.where((nl >= least) & (nr >= least), a / np.maximum(nl, 1e-300) + b / np.maximum(nr, 1e-300), -np.inf)
            at = int(gain.argmax())
            if np.isfinite(gain[at]) and (best is None or gain[at] > best[0]):
                best = (gain[at], int(j), float(cuts[t, node, j][at]))
        if best is None:
            continue
        _, tree.feature[node], tree.threshold[node] = best
        tree.left[node], tree.right[node] = len(tree.feature), len(tree.feature) + 1
        for side in (tree.left[node], tree.right[node]):
            for a, v in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, 0), (tree.right, 0), (tree.value, None)):
                a.append(v)
            new.append((t, side))
    return new


def predict(rows: DataFrame, forest: list[Tree], m: int, hard: bool, classes: int) -> DataFrame:
    """(row_idx, features): mean class shares (or shares of votes) of the trees, or the mean of their values, in one pass."""
    shared = session().sparkContext.broadcast(forest)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = [np.array(t.value) for t in shared.value]
        for p in parts:
            if len(p):
                x = stack(p["features"], m)
                found = [v[t.place(x)] for t, v in zip(shared.value, values, strict=True)]
                if hard and classes:
                    found = [np.eye(classes)[f.argmax(axis=1)] for f in found]
                yield pd.DataFrame({"row_idx": p["row_idx"], "features": list(np.mean(found, axis=0))})

    return rows.select("row_idx", "features").mapInPandas(run, "row_idx bigint, features array<double>")
