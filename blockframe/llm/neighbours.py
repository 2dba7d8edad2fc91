"""The k most similar vectors of every vector (problem 2).

Balanced posting lists. Centroids come from median splits of a bounded sample of at most ``SAMPLE`` distinct vectors, so each
list gets about as many vectors as any other; every vector is indexed. A vector near a boundary is put into each list whose
centroid is at most ``1 + REPLICATE`` times as far as the nearest one, unless a chosen centroid lies between. Centroids are found by
beam search in an in-memory graph of their nearest neighbours; a query reads the lists whose distance ratio is within
``1 + PRUNE``, at most ``PROBES``. Lists over ``LIST_CAP`` vectors are cut into shards, and their queries too, so no task holds more.

The exact check that follows computes the box of every list and reads, for each query, the unread lists whose box reaches
into the ball of its k-th distance. Results are then exact: Euclidean distance, equal distances by smaller row id.

Equal vectors are one entry with its ``k + 1`` smallest row ids, since no further copy can be among the k nearest of any row; every
row receives the result of its vector, without itself.

Defined cases: rows with null, NaN, infinite or non-positive measures are neither queries nor results; with fewer than k other rows all
of them come out; row ids are assumed unique; an empty table gives an empty result; other columns, whatever their names, are unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockframe.llm.proportions import finite
from blockframe.operators.skew import fragment_replicate_join
from blockframe.plans.runtime import durable, shuffle_tasks

SAMPLE, LIST, LIST_CAP = 100_000, 256, 4096
REPLICATE, REPLICAS = 0.10, 3
PRUNE, PROBES = 0.5, 6
DEGREE, BEAM, PIVOTS = 10, 10, 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``a`` to each of ``b``, summed dimension by dimension."""
    out = np.subtract.outer(a[:, 0], b[:, 0]) ** 2
    for j in range(1, a.shape[1]):
        out += np.subtract.outer(a[:, j], b[:, j]) ** 2
    return out


def split_balanced(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Index arrays of ``parts`` balanced groups: repeated median splits along the direction of largest variance."""
    out, open_ = [], [(np.arange(len(x)), parts)]
    while open_:
        rows, k = open_.pop()
        if k <= 1 or len(rows) < 2:
            out.append(rows)
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        cut = len(rows) * (k // 2) // k
        order = rows[np.argsort(centred @ direction, kind="stable")]
        open_ += [(order[:cut], k // 2), (order[cut:], k - k // 2)]
    return [r for r in out if len(r)]


class CentroidGraph:
    """Centroids with the graph of their nearest neighbours; a few spread pivots are where searches begin."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        self.links = np.empty((n, min(DEGREE, n)), np.int32)
        for i in range(0, n, 512):
            d = distances(centroids[i : i + 512], centroids)
            self.links[i : i + 512] = np.argsort(d, axis=1, kind="stable")[:, : self.links.shape[1]]
        self.pivots = np.unique(np.linspace(0, n - 1, min(PIVOTS, n)).astype(np.int32))

    def _among(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = (q[:, 0, None] - self.c[ids, 0]) ** 2
        for j in range(1, q.shape[1]):
            out += (q[:, j, None] - self.c[ids, j]) ** 2
        return out

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the k nearest centroids of each row, nearest first."""
        width = min(max(BEAM, k), len(self.c))
        beam = np.tile(self.pivots, (len(q), 1))
        for _ in range(64):
            d = self._among(q, beam)
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            kept, kept_d = np.take_along_axis(beam, order, 1), np.take_along_axis(d, order, 1)
            wide = np.concatenate([kept, self.links[kept].reshape(len(q), -1)], axis=1)
            wide.sort(axis=1)
            again = np.concatenate([np.zeros((len(q), 1), bool), wide[:, 1:] == wide[:, :-1]], axis=1)
            d = np.where(again, np.inf, self._among(q, wide))
            best = np.argpartition(d, min(width, d.shape[1] - 1), axis=1)[:, :width]
            new_d = np.take_along_axis(d, best, 1)
            beam = np.take_along_axis(wide, best, 1)
            if kept.shape == beam.shape and np.all(np.sort(new_d, axis=1) >= kept_d):
                break
        order = np.lexsort((beam, new_d), axis=1)[:, :k]
        return np.take_along_axis(beam, order, 1), np.take_along_axis(new_d, order, 1)


def lists_of(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: where each vector is stored."""
    ids, d = graph.search(x, REPLICAS)
    keep = (d <= d[:, :1] * (1 + REPLICATE) ** 2) & np.isfinite(d)
    for j in range(1, ids.shape[1]):
        for i in range(j):
            between = ((graph.c[ids[:, i]] - graph.c[ids[:, j]]) ** 2).sum(axis=1) < d[:, j]
            keep[:, j] &= ~(keep[:, i] & between)
    rows, places = np.nonzero(keep)
    return rows, ids[rows, places]


def probes_of(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the lists each query reads."""
    ids, d = graph.search(x, PROBES)
    rows, places = np.nonzero((d <= d[:, :1] * (1 + PRUNE) ** 2) & np.isfinite(d))
    return rows, ids[rows, places]


class Boxes:
    """Boxes of the lists, in blocks with a box each, to find the lists that reach into a ball."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray):
        parts = split_balanced((low + high) / 2, max(1, int(len(ids) ** 0.5)))
        self.blocks = [(ids[p], low[p], high[p], low[p].min(axis=0), high[p].max(axis=0)) for p in parts]

    def reach(self, q: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs with squared box distance at most ``radius2``."""
        rows, lists = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for ids, low, high, block_low, block_high in self.blocks:
            at = np.flatnonzero((np.maximum(0, np.maximum(block_low - q, q - block_high)) ** 2).sum(axis=1) <= radius2)
            if len(at):
                out = np.zeros((len(at), len(ids)))
                for j in range(q.shape[1]):
                    x = q[at, j, None]
                    out += np.maximum(0, np.maximum(low[:, j] - x, x - high[:, j])) ** 2
                i, j = np.nonzero(out <= radius2[at, None])
                rows.append(at[i])
                lists.append(ids[j])
        return np.concatenate(rows), np.concatenate(lists)


def nearest_rows(q: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row ids and squared distances of the k nearest rows of each query among vectors ``x`` that stand for rows ``ids``.

    ``x`` is in the order of its first ids, so equal distances keep that order. Missing places have id -1 and distance inf.
    """
    wide = max(len(i) for i in ids)
    padded = np.full((len(ids), wide), -1, np.int64)
    for a, i in enumerate(ids):
        padded[a, : len(i)] = i
    out_id, out_d = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf)
    step = max(1, 1_000_000 // len(x))
    for at in range(0, len(q), step):
        d = distances(q[at : at + step], x)
        if len(x) > k + 1:
            best = np.argpartition(d, k, axis=1)[:, : k + 1]
            best.sort(axis=1)
            bd = np.take_along_axis(d, best, 1)
            order = np.argsort(bd, axis=1, kind="stable")
            best, bd = np.take_along_axis(best, order, 1), np.take_along_axis(bd, order, 1)
            tied = np.flatnonzero(bd[:, k - 1] == bd[:, k])  # the order among equals was lost: sort these in full
            best, bd = best[:, :k], bd[:, :k]
            for r in tied:
                best[r] = np.argsort(d[r], kind="stable")[:k]
                bd[r] = d[r][best[r]]
        else:
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            bd = np.take_along_axis(d, best, 1)
        rows = padded[best].reshape(len(best), -1)
        row_d = np.where(rows < 0, np.inf, np.repeat(bd, wide, axis=1))
        order = np.lexsort((rows, row_d), axis=1)[:, :k]
        n = order.shape[1]
        out_d[at : at + step, :n] = np.take_along_axis(row_d, order, 1)
        out_id[at : at + step, :n] = np.where(np.isinf(out_d[at : at + step, :n]), -1, np.take_along_axis(rows, order, 1))
    return out_id, out_d


def distinct_vectors(df: DataFrame, row_id: str, columns: list[str], copies: int) -> DataFrame:
    """(vid, x ARRAY, ids ARRAY): each distinct usable vector with the ``copies`` smallest of its row ids."""
    rows = df.filter(finite(columns)).select(F.col(row_id).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("id"))).filter(F.col("n") <= copies)
    return first.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("vid"), "x", "ids")


class Index:
    """Posting lists over distinct vectors."""

    def __init__(self, vectors: DataFrame, k: int, sample: int = SAMPLE, list_size: int = LIST, seed: int = 42):
        self.vectors, self.k, self.spark = vectors, k, vectors.sparkSession
        n = vectors.count()
        share = min(1.0, sample / max(n, 1))
        drawn = vectors.select("x") if share == 1 else vectors.filter(F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).select("x")
        x = np.array([r.x for r in drawn.limit(2 * sample).collect()], float)
        lists = int(max(1, min(-(-n // list_size), len(x) // 8)))
        centroids = np.array([x[p].mean(axis=0) for p in split_balanced(x, lists)]) if len(x) else np.zeros((1, 1))
        self.graph = self.spark.sparkContext.broadcast(CentroidGraph(centroids))
        self.postings = durable(self._place(vectors, lists_of, "vid bigint, x array<double>, ids array<bigint>, list int"))
        d = len(centroids[0])
        corner = [f(F.col("x")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(d)]
        boxes = self.postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), *corner).collect()
        self.boxes = Boxes(np.array([b["list"] for b in boxes], np.int32), *(np.array([[b[f"{s}{j}"] for j in range(d)] for b in boxes], float).reshape(-1, d) for s in ("low", "high")))
        self.shards = {b["list"]: -(-b["n"] // LIST_CAP) for b in boxes if b["n"] > LIST_CAP}

    def _place(self, df: DataFrame, where, schema: str) -> DataFrame:
        graph = self.graph

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at in range(0, len(part), 4096):
                    rows, lists = where(graph.value, np.array(part["x"].iloc[at : at + 4096].tolist(), float))
                    yield part.iloc[rows + at].assign(list=lists.astype("int32"))

        return df.mapInPandas(run, schema)

    def read(self, queries: DataFrame) -> DataFrame:
        """(vid, near): rows near queries (vid, x, list, far), the nearest of a list no farther than ``far`` as structs (d squared, id)."""
        k = self.k
        shards = F.lit(1)
        if self.shards:
            shards = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in self.shards.items() for v in pair]), F.col("list")), F.lit(1))
        own, other = F.pmod(F.xxhash64("vid"), shards).cast("int"), F.explode(F.sequence(F.lit(0), shards - 1))
        stored = self.postings.select("list", own.alias("v"), other.alias("q"), "vid", "x", "ids")
        asked = queries.select("list", other.alias("v"), own.alias("q"), "vid", "x", "far")

        def run(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(stored):
                return pd.DataFrame({"vid": [], "d": [], "id": []}, dtype=object)
            stored = stored.sort_values("vid")
            ids, d = nearest_rows(np.array(asked["x"].tolist(), float), np.array(stored["x"].tolist(), float), list(stored["ids"]), k + 1)
            hits = (ids >= 0) & (d <= asked["far"].to_numpy(float)[:, None])
            some = np.flatnonzero(hits.any(axis=1))
            lists = {name: pd.Series([values[i][hits[i]] for i in some], dtype=object) for name, values in (("d", d), ("id", ids))}
            return pd.DataFrame({"vid": asked["vid"].to_numpy()[some], **lists})

        n = shuffle_tasks(self.spark)
        asked, stored = asked.repartition(n, "list", "v", "q"), stored.repartition(n, "list", "v", "q")
        found = asked.groupBy("list", "v", "q").cogroup(stored.groupBy("list", "v", "q")).applyInPandas(run, "vid bigint, d array<double>, id array<bigint>")
        return found.select("vid", F.arrays_zip("d", "id").alias("near"))

    def first(self) -> DataFrame:
        """(vid, x, list, far): every vector with the lists that its distance ratios select."""
        return self._place(self.vectors.select("vid", "x"), probes_of, "vid bigint, x array<double>, list int").withColumn("far", F.lit(float("inf")))

    def search(self, check: bool = True) -> DataFrame:
        """(vid, near): for every vector the k + 1 nearest rows as structs (d squared, id), in order; exact with the check over list boxes."""
        k = self.k

        def top(rows: DataFrame) -> DataFrame:
            return rows.groupBy("vid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))

        asked = durable(self.first())
        first = durable(top(self.read(asked)))
        if not check:
            return first
        boxes = self.spark.sparkContext.broadcast(self.boxes)

        def unread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                radius2 = part["far"].to_numpy(float) * (1 + 1e-12)
                for at in range(0, len(part), 8192):
                    here = part.iloc[at : at + 8192]
                    rows, lists = boxes.value.reach(np.array(here["x"].tolist(), float), radius2[at : at + 8192])
                    done = pd.MultiIndex.from_arrays([np.repeat(np.arange(len(here)), here["lists"].str.len()), np.concatenate([np.asarray(v) for v in here["lists"]])])
                    new = ~pd.MultiIndex.from_arrays([rows, lists]).isin(done)
                    yield here.iloc[rows[new]][["vid", "x", "far"]].assign(list=lists[new].astype("int32"))

        far = F.when(F.size("near") > k, F.col("near")[k]["d"]).otherwise(F.lit(float("inf")))
        known = asked.groupBy("vid").agg(F.first("x").alias("x"), F.collect_list("list").alias("lists")).join(first.select("vid", far.alias("far")), "vid", "left")
        more = self.read(known.fillna(float("inf"), ["far"]).mapInPandas(unread, "vid bigint, x array<double>, far double, list int"))
        return top(first.unionByName(more))


def nearest(df: DataFrame, row_id: str, columns: list[str], k: int = 5) -> DataFrame:
    """(row_id, near): for every usable row its k nearest other usable rows, an array of structs (d squared, id) in order."""
    vectors = durable(distinct_vectors(df, row_id, columns, k + 1))
    found = Index(vectors, k).search()
    results = vectors.select("vid", "x").join(found, "vid").select("x", "near")
    rows = df.filter(finite(columns)).select(F.col(row_id).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    joined = fragment_replicate_join(rows, results, ["x"])
    others = F.filter("near", lambda e: e["id"] != F.col("id"))
    return joined.select(F.col("id").alias(row_id), F.slice(others, 1, k).alias("near"))
