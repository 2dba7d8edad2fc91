"""Greedy clustering of a distance matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray
from blockframe.estimator import Estimator
from blockframe.operators.proximity import range_join
from blockframe.plans.index import DRIVER_VALUES
from blockframe.plans.runtime import durable


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (i, j) of each batch in one row: the i of every run of equal ones, the lengths of runs, all j."""
    for b in batches:
        if len(b):
            i, j = b["i"].to_numpy(), b["j"].to_numpy().astype(np.int32)
            begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            columns = [pa.array(x) for x in (i[begins], np.diff(np.r_[begins, len(i)]).astype(np.int32), j)]
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["i", "n", "j"])


def _runs(links: DataFrame, find: Callable, *vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of numbers that ``find(i, n, j, begins, *vectors)`` gives for packed links."""
    shared = links.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, n, j = (b[c].flatten().to_numpy() for c in ("i", "n", "j"))
            if len(i):
                yield pa.record_batch([pa.array(x.astype(np.int64)) for x in find(i, n, j, np.cumsum(n) - n, *shared.value)], names=["a", "b"])

    found = links.mapInArrow(run, "a bigint, b bigint").toArrow()
    shared.destroy()
    return found["a"].to_numpy(), found["b"].to_numpy()


def _counts(i, n, j, begins, alive):
    """Rows left, and how many of a run's other rows are left."""
    c = np.add.reduceat(alive[j], begins, dtype=np.int64)
    kept = alive[i] & (c > 0)
    return i[kept], c[kept]


def _largest(i, n, j, begins, key):
    """Rows left, and the largest key of a run's other rows."""
    kept = key[i] >= 0
    return i[kept], np.maximum.reduceat(key[j], begins)[kept]


def _members(i, n, j, begins, first, alive):
    kept = np.repeat(first[i], n) & alive[j]
    return np.repeat(i, n)[kept], j[kept]


class Daura(Estimator):
    """Take the row with most others within ``cutoff`` (the first among equals) with them as a cluster, remove them, and repeat.

    Singletons are not reported. A row that comes before all rows within two links of it is taken whatever happens elsewhere: clusters taken
    earlier touch neither it nor its neighbours, and counts only fall. So each round takes all such rows at once, and clusters come out in the order
    of their sizes, which is the order in which they would be taken one by one. Neighbour lists stay distributed: written out once, they are read
    against a number for every row, which the driver holds; beyond ``DRIVER_VALUES`` they are joined.
    """

    def __init__(self, cutoff: float):
        self.cutoff = cutoff

    def neighbours(self, distances: DsArray) -> DataFrame:
        """(i, j) of different rows at most ``cutoff`` apart."""
        return distances.to_dense().entries().filter((F.col("v") <= self.cutoff) & (F.col("i") != F.col("j"))).select("i", "j")

    def near(self, points: DsArray) -> DataFrame:
        """(i, j) of different rows of ``points`` at most ``cutoff`` apart, without a matrix of distances."""
        df = points.to_dense().df
        return range_join(df, df, self.cutoff, list(range(points.shape[1]))).filter("i <> j").select("i", "j")

    def clusters(self, distances: DsArray) -> DataFrame:
        """(centre, size, member): every cluster's centre, its number of other members, and each of these."""
        return self.clusters_of(self.neighbours(distances), distances.shape[0])

    def clusters_of(self, links: DataFrame, rows: int) -> DataFrame:
        """``clusters`` from the links (i, j), in both directions, of rows numbered from 0."""
        if 4 * rows > DRIVER_VALUES:
            return self._joined(durable(links))
        packed = durable(links.select("i", "j").mapInArrow(_pack, "i array<bigint>, n array<int>, j array<int>"))
        alive, found = np.ones(rows, bool), [np.zeros((3, 0), np.int64)]
        while True:
            counts = np.zeros(rows, np.int64)
            np.add.at(counts, *_runs(packed, _counts, alive))
            if not counts.any():
                break
            #: Larger counts come first, then smaller rows; rows without others are out.
            key = np.where(counts > 0, counts * rows + (rows - 1 - np.arange(rows)), -1)
            best = key
            for _ in range(2):
                here, seen = _runs(packed, _largest, best)
                best = best.copy()
                np.maximum.at(best, here, seen)
            first = (key >= 0) & (best == key)
            centre, member = _runs(packed, _members, first, alive)
            found.append(np.stack([centre, counts[centre], member]))
            alive[centre] = alive[member] = False
        table = pa.table(dict(zip(("centre", "size", "member"), np.concatenate(found, axis=1), strict=True)))
        return links.sparkSession.createDataFrame(table)

    def _joined(self, links: DataFrame) -> DataFrame:
        taken = None
        while not links.isEmpty():
            #: Larger counts come first, then smaller rows.
            rank = links.groupBy("i").agg(F.struct(F.count(F.lit(1)).alias("n"), (-F.col("i")).alias("r")).alias("key"))
            best = rank
            for _ in range(2):
                seen = links.join(best.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.max("key").alias("near"))
                best = best.join(seen, "i").select("i", F.greatest("key", "near").alias("key"))
            first = best.join(rank.withColumnRenamed("key", "own"), "i").filter(F.col("key") == F.col("own"))
            found = durable(links.join(first.select(F.col("i"), F.col("own.n").alias("size")), "i").select(F.col("i").alias("centre"), "size", F.col("j").alias("member")))
            gone = found.select(F.col("member").alias("g")).unionByName(found.select(F.col("centre").alias("g"))).distinct()
            for side in "ij":
                links = links.join(gone, F.col(side) == F.col("g"), "left_anti")
            links = durable(links)
            taken = found if taken is None else taken.unionByName(found)
        return taken if taken is not None else links.select(F.col("i").alias("centre"), F.lit(0).cast("bigint").alias("size"), F.col("j").alias("member"))

    def fit_predict(self, distances: DsArray) -> list[list[int]]:
        """Clusters, each with its centre first and then its members in order."""
        rows = self.clusters(distances).groupBy("centre", "size").agg(F.sort_array(F.collect_list("member")).alias("members"))
        return [[r["centre"], *r["members"]] for r in rows.orderBy(F.desc("size"), "centre").collect()]
