"""Global sorts, permutations and splits of rows.

Random order is the order of a portable hash of the row number, so it is the same on any partitioning and in any engine.
"""

from __future__ import annotations

import math
import numbers

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray
from blockframe.plans.index import dense_index

#: Rows of a block that one task sorts.
WINDOW_ROWS = 1_000_000
#: Fixed values of the multiplicative hash; products of two values below them stay within a BIGINT.
FACTOR, FACTOR_2, SEED_FACTOR, MODULUS = 2654435761, 2246822519, 40503, 1 << 31


def hash_order(row: Column, seed: int) -> Column:
    """A portable pseudo-random BIGINT of a row number."""
    mixed = ((row % F.lit(MODULUS)) * F.lit(FACTOR) + F.lit(int(seed) * SEED_FACTOR)) % F.lit(MODULUS)
    return (mixed.bitwiseXOR(F.shiftright(mixed, 15)) * F.lit(FACTOR_2)) % F.lit(MODULUS)


class TeraSort:
    """Sort values globally by range buckets.

    Without ``column_indexes`` all values are sorted and refilled row by row; with them each listed column is sorted on its own and only
    those come out. Buckets are quantile ranges chosen by sampling, so no value is lost, whatever range was learned.
    """

    def __init__(self, range_min=0, range_max=100, column_indexes=None, num_buckets=None):
        self.range_min, self.range_max, self.column_indexes, self.num_buckets = range_min, range_max, column_indexes, num_buckets
        if num_buckets is not None and not isinstance(num_buckets, numbers.Integral):
            raise ValueError("num_buckets must be an integer")
        sizes = {len(r) for r in (range_min, range_max) if isinstance(r, (list, tuple, np.ndarray))}
        if column_indexes is not None and sizes - {len(column_indexes)}:
            raise ValueError("a range is needed for each column")
        if np.any(np.asarray(range_min, float) >= np.asarray(range_max, float)):
            raise ValueError("range_min must be below range_max")

    def fit(self, x: DsArray) -> TeraSort:
        """Learn the range of the values (of each column)."""
        if not isinstance(x, DsArray):
            raise ValueError("an array is needed")
        if self.column_indexes is None:
            cells = x.to_dense().entries()
            self.range_min, self.range_max = cells.agg(F.min("v"), F.max("v")).first()
        else:
            picked = x[:, list(self.column_indexes)]
            self.range_min = np.atleast_1d(picked.min(0).collect()).tolist()
            self.range_max = np.atleast_1d(picked.max(0).collect()).tolist()
        return self

    def sort(self, x: DsArray) -> DsArray:
        if not isinstance(x, DsArray):
            raise ValueError("an array is needed")
        if self.column_indexes is None:
            n, m = x.shape
            ranked = dense_index(x.to_dense().entries().select("v", "i", "j"), ["v", "i", "j"], "r")
            row, key = F.floor(F.col("r") / m), F.col("r") % m
        else:
            picked = x[:, list(self.column_indexes)].to_dense()
            n, m = picked.shape
            ranked = dense_index(picked.entries(), ["j", "v", "i"], "r")
            row, key = F.col("r") % n, F.col("j")
        cells = ranked.select(row.alias("row_idx"), key.alias("k"), "v")
        rows = cells.groupBy("row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("features"))
        return DsArray(rows, (n, m), False, x.block_size)


def quantile_points(x: DsArray, column: int, points: int, accuracy: int = 10_000) -> list[float]:
    """Bucket bounds of a column: ``points`` quantiles in one pass."""
    shares = [(i + 1) / (points + 1) for i in range(points)]
    value = F.get("features", F.lit(column))
    return x.to_dense().df.agg(F.percentile_approx(value, shares, accuracy)).first()[0] or []


def shuffle(x: DsArray, y: DsArray | None = None, random_state: int = 0):
    """Rows in a random order, the same for x and y."""
    seed = 0 if random_state is None else int(random_state)
    order = [hash_order(F.col("row_idx"), seed), F.col("row_idx")]
    dense = x.to_dense()
    if y is None:
        return dense._new(dense_index(dense.df.withColumnRenamed("row_idx", "__old"), [hash_order(F.col("__old"), seed), F.col("__old")]).select("row_idx", "features"))
    both = dense.df.join(y.to_dense().df.select("row_idx", F.col("features").alias("__y")), "row_idx").withColumn("__h", order[0])
    new = dense_index(both.withColumnRenamed("row_idx", "__old"), ["__h", "__old"])
    return dense._new(new.select("row_idx", "features")), y._new(new.select("row_idx", F.col("__y").alias("features")), sparse=False)


def _share(size, default: float) -> float:
    if size is None:
        return default
    if not 0 < size < 1:
        raise ValueError("sizes are shares between 0 and 1")
    return float(size)


def train_test_split(x: DsArray, y: DsArray | None = None, test_size=None, train_size=None, random_state: int = 0, block_rows: int | None = None):
    """Random train and test rows of every block of ``block_rows`` (default: the block hint), ``floor(rows * share)`` of each.

    Returns (train, test) or (train_x, test_x, train_y, test_y). Order within a block is the portable hash order.
    """
    if test_size is None and train_size is None:
        test_size = 0.25
    test = _share(test_size, 1 - _share(train_size, 0.75))
    train = _share(train_size, 1 - test)
    if train + test > 1 + 1e-12:
        raise ValueError("the shares exceed 1")
    h = block_rows or x.block_size[0]
    seed = 0 if random_state is None else int(random_state)
    dense = x.to_dense()
    rows = dense.df if y is None else dense.df.join(y.to_dense().df.select("row_idx", F.col("features").alias("__y")), "row_idx")
    rows = rows.withColumn("__b", F.floor(F.col("row_idx") / h)).withColumn("__h", hash_order(F.col("row_idx"), seed))
    if h <= WINDOW_ROWS:  # a block is one task's work
        place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "row_idx")) - 1
        ranked = rows.withColumn("__place", place)
    else:
        ranked = dense_index(rows.withColumnRenamed("row_idx", "__old"), ["__b", "__h", "__old"], "__at").withColumn("__place", F.col("__at") - F.col("__b") * h)
    size = F.least(F.lit(h), F.lit(x.shape[0]) - F.col("__b") * h)
    first, rest = math.floor(h * train + 1e-9), math.floor(h * test + 1e-9)  # of a whole block
    n_train, n_test = F.floor(size * F.lit(train) + F.lit(1e-9)), F.floor(size * F.lit(test) + F.lit(1e-9))
    out, last = [], x.shape[0] % h
    for chosen, begin, each, share in (
        (F.col("__place") < n_train, F.lit(0), first, train),
        ((F.col("__place") >= n_train) & (F.col("__place") < n_train + n_test), n_train, rest, test),
    ):
        part = ranked.filter(chosen).withColumn("row_idx", (F.col("__b") * each + F.col("__place") - begin).cast("bigint"))
        n = x.shape[0] // h * each + math.floor(last * share + 1e-9)
        out.append([DsArray(part.select("row_idx", F.col(c).alias("features")), (n, a.shape[1]), False) for c, a in (("features", x), ("__y", y)) if a is not None])
    return tuple(part[k] for k in range(1 if y is None else 2) for part in out)


class KFold:
    """Contiguous folds; the first ``n % n_splits`` get one row more."""

    def __init__(self, n_splits: int = 5, shuffle: bool = False, random_state: int | None = None):
        if not isinstance(n_splits, numbers.Integral) or n_splits <= 1:
            raise ValueError("n_splits must be an integer above 1")
        if not isinstance(shuffle, bool):
            raise TypeError("shuffle must be a boolean")
        self.n_splits, self.shuffle, self.random_state = int(n_splits), shuffle, random_state

    def get_n_splits(self) -> int:
        return self.n_splits

    def bounds(self, n: int) -> list[tuple[int, int]]:
        sizes = [n // self.n_splits + (k < n % self.n_splits) for k in range(self.n_splits)]
        ends = np.cumsum(sizes).tolist()
        return [(e - s, e) for s, e in zip(sizes, ends, strict=True)]

    def split(self, x: DsArray, y: DsArray | None = None):
        """Pairs ((train_x, train_y), (test_x, test_y))."""
        if self.shuffle:
            x, y = shuffle(x, y, self.random_state or 0) if y is not None else (shuffle(x, None, self.random_state or 0), None)
        for begin, end in self.bounds(x.shape[0]):
            yield tuple((part(x), None if y is None else part(y)) for part in (lambda a: _without(a, begin, end), lambda a: a[begin:end]))


def _without(a: DsArray, begin: int, end: int) -> DsArray:
    key = "i" if a.sparse else "row_idx"
    kept = a.df.filter((F.col(key) < begin) | (F.col(key) >= end))
    return a._new(kept.withColumn(key, F.when(F.col(key) < begin, F.col(key)).otherwise(F.col(key) - (end - begin))), (a.shape[0] - (end - begin), a.shape[1]))


def infer_cv(cv=None):
    """A splitter: None is KFold(5), an integer the number of folds, anything with ``split`` itself."""
    if cv is None:
        return KFold()
    if isinstance(cv, numbers.Integral):
        return KFold(int(cv))
    if hasattr(cv, "split") and hasattr(cv, "get_n_splits"):
        return cv
    raise ValueError("cv must be None, an integer or a splitter")
