"""Grouping vectors into clusters of mutually similar ones (problem 6).

Cluster-feature trees: each partition sums its vectors into cluster features (count, linear sum, sum of squares) of small grid
cells and inserts those into a height-balanced tree whose leaf entries have a radius below a threshold; a tree that outgrows
``LEAVES`` entries is built again with a larger threshold. Leaf summaries of the partitions are merged in a tree reduction
and agglomerated by Ward's criterion. One pass over the data then assigns every vector, and each cluster comes out with its size and
the rows nearest to its centroid.

:func:`linked` finds the clusters of vectors joined by steps of at most ``eps``. Leaves of the same trees are its neighbourhoods: a
vector belongs to its nearest leaf and visits every leaf whose centroid is at most ``2 * eps`` farther, so any two vectors within
``eps`` meet in the leaf of either. Each leaf joins its vectors exactly; components that meet in a visiting vector are joined by
contraction rounds over leaf components, never on the driver. A leaf of over ``LEAF_CAP`` vectors is cut into cells with margins.
Distances up to ``eps`` plus 1e-11 count, which for values of six decimals is the exact decimal comparison.

Defined cases: rows with null, NaN, infinite or non-positive measures belong to no cluster; equal vectors are handled once and count with all
their rows; ties in distance go by row id; an empty table gives an empty result; other columns, whatever their names, are unused.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockframe.llm.proportions import finite
from blockframe.operators.skew import fragment_replicate_join
from blockframe.plans.graph import components, contract
from blockframe.plans.runtime import durable

LEAVES, BRANCH, ARITY = 4096, 32, 8
LEAF_CAP = 20_000
SLACK = 1e-11
#: Dimensions up to which cells find their neighbours; pairs of points of two cells that are compared at once.
CELL_DIMENSIONS, FEW_PAIRS = 4, 256


class Node:
    """A tree node: cluster features of its entries and, unless it is a leaf, their child nodes."""

    __slots__ = ("children", "k", "n", "s", "ss")

    def __init__(self, d: int, leaf: bool):
        self.k, self.n, self.s, self.ss = 0, np.zeros(BRANCH + 1), np.zeros((BRANCH + 1, d)), np.zeros(BRANCH + 1)
        self.children: list[Node] | None = None if leaf else []

    def append(self, n: float, s: np.ndarray, ss: float, child: Node | None = None) -> None:
        self.n[self.k], self.s[self.k], self.ss[self.k] = n, s, ss
        self.k += 1
        if child is not None:
            self.children.append(child)

    def total(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.k].sum(), self.s[: self.k].sum(axis=0), self.ss[: self.k].sum()


class CFTree:
    """A cluster-feature tree over ``d`` dimensions."""

    def __init__(self, d: int, threshold: float, leaves: int = LEAVES):
        self.d, self.threshold, self.leaves = d, threshold, leaves
        self.root, self.size = Node(d, True), 0

    def insert(self, n: float, s: np.ndarray, ss: float) -> None:
        """Insert one cluster feature."""
        x, node, path = s / n, self.root, []
        while True:
            k = node.k
            i = int(((node.s[:k] / node.n[:k, None] - x) ** 2).sum(axis=1).argmin()) if k else -1
            path.append((node, i))
            if node.children is None:
                break
            node = node.children[i]
        if i >= 0:
            m, ms, mss = node.n[i] + n, node.s[i] + s, node.ss[i] + ss
            if mss / m - ((ms / m) ** 2).sum() <= self.threshold**2:
                for p, j in path:
                    p.n[j] += n
                    p.s[j] += s
                    p.ss[j] += ss
                return
        for p, j in path[:-1]:
            p.n[j] += n
            p.s[j] += s
            p.ss[j] += ss
        node.append(n, s, ss)
        self.size += 1
        while path and path[-1][0].k > BRANCH:
            node, _ = path.pop()
            left, right = self._split(node)
            if not path:
                self.root = Node(self.d, False)
                for part in (left, right):
                    self.root.append(*part.total(), part)
                break
            parent, j = path[-1]
            parent.n[j], parent.s[j], parent.ss[j] = left.total()
            parent.children[j] = left
            parent.append(*right.total(), right)
        if self.size > self.leaves:
            self.rebuild(self.threshold * 1.5)

    def _split(self, node: Node) -> tuple[Node, Node]:
        k = node.k
        c = node.s[:k] / node.n[:k, None]
        d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        a, b = divmod(int(d.argmax()), k)
        out = Node(self.d, node.children is None), Node(self.d, node.children is None)
        near_b = d[b] < d[a]
        near_b[a], near_b[b] = False, True
        for i in range(k):
            out[int(near_b[i])].append(node.n[i], node.s[i], node.ss[i], node.children[i] if node.children is not None else None)
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, linear sums and sums of squares of the leaf entries."""
        stack, found = [self.root], []
        while stack:
            node = stack.pop()
            if node.children is None:
                found.append((node.n[: node.k], node.s[: node.k], node.ss[: node.k]))
            else:
                stack += node.children
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def rebuild(self, threshold: float) -> None:
        n, s, ss = self.entries()
        self.threshold, self.root, self.size = threshold, Node(self.d, True), 0
        self.add(n, s, ss)

    def add(self, n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> None:
        """Insert many cluster features, those of a small grid cell summed first."""
        if not len(n):
            return
        cell = np.floor(s / n[:, None] / (self.threshold / (2 * self.d**0.5))).astype(np.int64)
        _, at = np.unique(cell, axis=0, return_inverse=True)
        at = at.ravel()
        m = np.bincount(at, n)
        ms = np.stack([np.bincount(at, s[:, j]) for j in range(self.d)], axis=1)
        for row in zip(m.tolist(), ms, np.bincount(at, ss).tolist(), strict=True):
            self.insert(*row)


def _summaries(d: int, threshold: float, leaves: int):
    """Functions that sum a partition of vectors, and that merge summaries."""

    def frame(tree: CFTree | None, part: int) -> pd.DataFrame:
        if tree is None:
            return pd.DataFrame({"part": [], "n": [], "s": [], "ss": [], "t": []}).astype({"s": object})
        n, s, ss = tree.entries()
        return pd.DataFrame({"part": part, "n": n, "s": list(s), "ss": ss, "t": tree.threshold})

    def sum_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, part = None, 0
        for p in parts:
            if len(p):
                tree = tree or CFTree(d, threshold, leaves)
                part = int(p["part"].iloc[0])
                x, w = np.array(p["x"].tolist(), float), p["n"].to_numpy(float)
                tree.add(w, x * w[:, None], (x**2).sum(axis=1) * w)
        yield frame(tree, part)

    def merge(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        tree = CFTree(d, float(p["t"].max()), leaves)
        order = np.lexsort((p["ss"].to_numpy(), p["n"].to_numpy()))
        tree.add(p["n"].to_numpy()[order], np.array(p["s"].tolist(), float)[order], p["ss"].to_numpy()[order])
        return frame(tree, int(key[0]))

    return sum_up, merge


def leaf_summaries(vectors: DataFrame, d: int, threshold: float, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Counts and centroids of at most ``leaves`` leaf entries over all of ``vectors`` (x ARRAY, n rows that it stands for)."""
    sum_up, merge = _summaries(d, threshold, leaves)
    schema = "part int, n double, s array<double>, ss double, t double"
    parts = vectors.rdd.getNumPartitions()
    out = vectors.select(F.spark_partition_id().alias("part"), "x", F.col("n").cast("double").alias("n")).mapInPandas(sum_up, schema)
    while True:
        parts = -(-parts // ARITY)
        out = out.withColumn("part", F.floor(F.col("part") / ARITY).cast("int")).groupBy("part").applyInPandas(merge, schema)
        if parts <= 1:
            break
    rows = out.select("n", "s").collect()
    n = np.array([r["n"] for r in rows], float)
    return n, np.array([r["s"] for r in rows], float).reshape(-1, d) / n[:, None]


def ward(n: np.ndarray, c: np.ndarray, clusters: int) -> np.ndarray:
    """Label of each of the weighted points after merging by Ward's criterion to ``clusters``, with nearest-neighbour chains."""
    size, centre = n.astype(float).copy(), c.astype(float).copy()
    alive, chain, merges = np.ones(len(n), bool), [], []
    for _ in range(max(0, len(n) - 1)):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            cost = size[i] * size / (size[i] + size) * ((centre - centre[i]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[i] = np.inf
            j = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        merges.append((float(cost[j]), i, j))
        centre[j] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[j] += size[i]
        alive[i] = False
    parent = np.arange(len(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, len(n) - clusters)]:
        parent[find(i)] = find(j)
    roots = np.array([find(i) for i in range(len(n))], int)
    order = {r: k for k, r in enumerate(sorted(set(roots.tolist()), key=lambda r: tuple(c[r])))}
    return np.array([order[r] for r in roots.tolist()], int)


def distinct_points(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(vid, x, n): each distinct usable vector, its smallest row id and its number of rows."""
    rows = df.filter(finite(columns)).select(F.col(row_id).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    return rows.groupBy("x").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("n")).select("vid", "x", "n")


def cluster(df: DataFrame, row_id: str, columns: list[str], clusters: int, threshold: float) -> tuple[DataFrame, np.ndarray]:
    """(row_id, cluster, distance) of every usable row, and the centroids: leaf summaries, Ward, one assignment pass."""
    rows = df.filter(finite(columns)).select(F.col(row_id).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    n, c = leaf_summaries(rows.withColumn("n", F.lit(1.0)), len(columns), threshold)
    labels = ward(n, c, clusters)
    centroids = np.array([np.average(c[labels == k], axis=0, weights=n[labels == k]) for k in range(labels.max() + 1 if len(labels) else 0)])

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.array(p["x"].tolist(), float)
                d = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
                k = d.argmin(axis=1)
                yield pd.DataFrame({row_id: p["id"], "cluster": k.astype("int32"), "distance": np.sqrt(d[np.arange(len(d)), k])})

    return rows.mapInPandas(assign, f"`{row_id}` bigint, cluster int, distance double"), centroids


def describe(assigned: DataFrame, row_id: str, typical: int = 5) -> DataFrame:
    """(cluster, size, rank, row_id, distance): the rows of each cluster nearest to its centroid."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    near = assigned.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", row_id))).filter(F.col("rank") <= typical)
    return near.join(sizes, "cluster").select("cluster", "size", "rank", row_id, "distance")


def link_points(x: np.ndarray, eps: float) -> np.ndarray:
    """Component (its smallest index) of each point under steps of at most ``eps``.

    Points of one cell of edge ``eps / sqrt(d)`` are all linked, whatever their number. Between two cells near each other one pair of points decides,
    looked for only where the cells are not joined yet, among the points that reach the other cell's box, block by block until one is found.
    """
    n, d = x.shape
    if d > CELL_DIMENSIONS:
        return _sweep(x, eps)
    _, cell, inverse, size = np.unique(np.floor(x / (eps / d**0.5)).astype(np.int64), axis=0, return_index=True, return_inverse=True, return_counts=True)
    cells = np.floor(x[cell] / (eps / d**0.5)).astype(np.int64)
    inverse = inverse.ravel()
    member = np.argsort(inverse, kind="stable")
    begin = np.r_[0, np.cumsum(size)]
    label, within = np.arange(len(cells)), (eps + SLACK) ** 2
    low, span = cells.min(axis=0) - 3, cells.max(axis=0) - cells.min(axis=0) + 7
    if np.prod(span.astype(float)) > 2.0**62:
        return _sweep(x, eps)
    weight = np.r_[np.cumprod(span[:0:-1])[::-1], 1]
    key = (cells - low) @ weight  # in the order of the cells
    for shift in product(range(-2, 3), repeat=d):
        step = np.array(shift)
        if shift <= (0,) * d or (np.maximum(np.abs(step) - 1, 0) ** 2).sum() > d:
            continue
        at = np.searchsorted(key, key + step @ weight)
        near = np.flatnonzero((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step @ weight))
        u, v = near, at[near]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
        few = size[u] * size[v] <= FEW_PAIRS
        hits = [np.zeros((0, 2), np.int64)]
        for k in range(0, int(few.sum()), 65_536):
            a, b = u[few][k : k + 65_536], v[few][k : k + 65_536]
            pairs = size[a] * size[b]
            which = np.repeat(np.arange(len(a)), pairs)
            place = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            p, q = member[begin[a[which]] + place // size[b[which]]], member[begin[b[which]] + place % size[b[which]]]
            linked = np.unique(which[((x[p] - x[q]) ** 2).sum(axis=1) <= within])
            hits.append(np.stack([a[linked], b[linked]], axis=1))
        for a, b in zip(u[~few].tolist(), v[~few].tolist(), strict=True):
            if _touch(x[member[begin[a] : begin[a + 1]]], x[member[begin[b] : begin[b + 1]]], eps + SLACK):
                hits.append(np.array([[a, b]]))
        found = np.concatenate(hits)
        label = components(np.r_[np.arange(len(label)), found[:, 0]], np.r_[label, found[:, 1]], len(label))
    first = np.full(len(label), n, np.int64)
    np.minimum.at(first, label[inverse], np.arange(n))
    return first[label[inverse]]


def _touch(a: np.ndarray, b: np.ndarray, reach: float) -> bool:
    """Whether any point of ``a`` is within ``reach`` of one of ``b``."""

    def reaching(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, np.maximum(q.min(axis=0) - p, p - q.max(axis=0)))
        d = (gap**2).sum(axis=1)
        return p[d <= reach**2][np.argsort(d[d <= reach**2], kind="stable")]

    a = reaching(a, b)
    b = reaching(b, a) if len(a) else b[:0]
    for i in range(0, len(a), 1024):
        for j in range(0, len(b), 1024):
            p, q = a[i : i + 1024], b[j : j + 1024]
            if (((p[:, None] - q[None]) ** 2).sum(axis=2) <= reach**2).any():
                return True
    return False


def _sweep(x: np.ndarray, eps: float) -> np.ndarray:
    """The components of points of many dimensions, whose cells have too many neighbours: a sweep along the widest dimension."""
    n, within = len(x), (eps + SLACK) ** 2
    axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
    order = np.argsort(x[:, axis], kind="stable")
    y, us, vs, held = x[order], [], [], 0
    label = np.arange(n)
    for shift in range(1, n):
        near = np.flatnonzero(y[shift:, axis] - y[:-shift, axis] <= eps + SLACK)
        if not len(near):
            break
        hit = near[((y[near + shift] - y[near]) ** 2).sum(axis=1) <= within]
        us.append(order[hit])
        vs.append(order[hit + shift])
        held += len(hit)
        if held > 2_000_000:
            label = components(np.concatenate([np.arange(n), *us]), np.concatenate([label, *vs]), n)
            us, vs, held = [], [], 0
    return components(np.concatenate([np.arange(n), *us]), np.concatenate([label, *vs]), n)


def _visits(parts: Iterator[pd.DataFrame], centroids: np.ndarray, eps: float) -> Iterator[pd.DataFrame]:
    """Each vector once for its own leaf and for every leaf at most 2 eps farther."""
    c2 = (centroids**2).sum(axis=1)
    for p in parts:
        for at in range(0, len(p), 1024):
            here = p.iloc[at : at + 1024]
            x = np.array(here["x"].tolist(), float)
            d = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + c2))
            i, j = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * eps + 1e-6)
            yield pd.DataFrame({"vid": here["vid"].to_numpy()[i], "x": list(x[i]), "leaf": j.astype("int32")})


def _cells(visits: DataFrame, d: int, eps: float, cap: int) -> DataFrame:
    """Leaves over ``cap`` vectors cut into cells of 4 eps with a margin of eps: (vid, x, leaf, cell)."""
    large = visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > cap).select("leaf").collect()
    if not large:
        return visits.withColumn("cell", F.lit(0).cast("bigint"))
    width, margin = 4 * eps, eps + SLACK
    spans = [F.sequence(F.floor((F.col("x")[j] - margin) / width), F.floor((F.col("x")[j] + margin) / width)) for j in range(d)]
    out = visits.withColumn("cut", F.col("leaf").isin([r["leaf"] for r in large]))
    for j, span in enumerate(spans):
        out = out.withColumn(f"c{j}", F.explode(F.when(F.col("cut"), span).otherwise(F.array(F.lit(0).cast("bigint")))))
    return out.select("vid", "x", "leaf", F.xxhash64(*[f"c{j}" for j in range(d)]).alias("cell"))


def linked(df: DataFrame, row_id: str, columns: list[str], eps: float, min_rows: int = 3, leaves: int = LEAVES, cap: int = LEAF_CAP) -> DataFrame:
    """(cluster_row, row_id): members of each largest set of at least ``min_rows`` rows joined by steps of at most ``eps``."""
    d = len(columns)
    points = durable(distinct_points(df, row_id, columns))
    _, centroids = leaf_summaries(points, d, 2 * eps, leaves)
    visits = durable(points.select("vid", "x").mapInPandas(lambda parts: _visits(parts, centroids, eps), "vid bigint, x array<double>, leaf int"))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vid").drop_duplicates("vid")
        label = link_points(np.array(part["x"].tolist(), float), eps)
        vid = part["vid"].to_numpy()
        return pd.DataFrame({"vid": vid, "local": vid[label]})

    local = durable(_cells(visits, d, eps, cap).groupBy("leaf", "cell").applyInPandas(join, "vid bigint, local bigint"))
    met = local.groupBy("vid").agg(F.min("local").alias("u"), F.collect_set("local").alias("all"))
    roots = contract(met.select("u", F.explode("all").alias("v")))
    own = met.select("vid", F.col("u").alias("node")).join(roots, "node", "left").select("vid", F.coalesce("root", "node").alias("root"))
    whole = points.join(own, "vid").select("x", "n", "vid", "root")
    sizes = whole.groupBy("root").agg(F.sum("n").alias("size"), F.min("vid").alias("cluster_row")).filter(F.col("size") >= min_rows)
    members = fragment_replicate_join(whole.select("x", "root"), sizes.select("root", "cluster_row"), ["root"]).select("x", "cluster_row")
    rows = df.filter(finite(columns)).select(F.col(row_id).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    return fragment_replicate_join(rows, members, ["x"]).select("cluster_row", F.col("id").alias(row_id))
