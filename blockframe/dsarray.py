"""Distributed two-dimensional arrays.

A :class:`DsArray` is an immutable plan with a shape. Dense arrays are rows ``(row_idx BIGINT, features ARRAY<DOUBLE>)``;
sparse arrays are entries ``(i, j, v)`` whose absent places are zeros. Row order is the order of ``row_idx``, always dense from 0.
Elementwise work stays in built-in higher-order functions; column statistics are partial aggregates.

Indexing with a list gives rows in the order of the list. ``block_size`` is a hint that only block-wise operations use.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.plans.index import stack

#: Columns up to which column statistics are one aggregate per column; beyond, values are exploded by column.
WIDE = 128
#: Values that a row array, a broadcast matrix or a collected result may hold.
LARGEST = 8_000_000


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.getOrCreate()


def _lit_array(values) -> Column:
    return F.lit([float(v) for v in values]) if len(values) else F.array().cast("array<double>")


@dataclass(frozen=True, eq=False)
class _Plan:
    df: DataFrame
    shape: tuple[int, int]
    sparse: bool
    block_size: tuple[int, int]


class DsArray:
    """A distributed matrix."""

    __array_priority__ = 100

    def __init__(self, df: DataFrame, shape: tuple[int, int], sparse: bool = False, block_size: tuple[int, int] | None = None):
        self._plan = _Plan(df, (int(shape[0]), int(shape[1])), sparse, block_size or (max(1, shape[0]), max(1, shape[1])))

    df = property(lambda self: self._plan.df)
    shape = property(lambda self: self._plan.shape)
    sparse = property(lambda self: self._plan.sparse)
    block_size = property(lambda self: self._plan.block_size)

    # -- representations

    def _new(self, df: DataFrame, shape: tuple[int, int] | None = None, sparse: bool | None = None) -> DsArray:
        return DsArray(df, shape or self.shape, self.sparse if sparse is None else sparse, self.block_size)

    def _map(self, f: Callable[[Column], Column]) -> DsArray:
        """A new array with ``f`` of every value (of every stored value, if sparse)."""
        if self.sparse:
            return self._new(self.df.select("i", "j", f(F.col("v")).alias("v")))
        return self._new(self.df.select("row_idx", F.transform("features", f).alias("features")))

    def entries(self) -> DataFrame:
        """(i, j, v): all values of a dense array, the stored ones of a sparse array."""
        if self.sparse:
            return self.df.select("i", "j", "v")
        return self.df.select(F.col("row_idx").alias("i"), F.posexplode("features").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), "v")

    def to_dense(self) -> DsArray:
        """Row form; every row present."""
        if not self.sparse:
            return self
        n, m = self.shape
        _check_width(m)
        pairs = self.df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), "v"))).alias("at"))
        rows = session().range(n).join(pairs, F.col("id") == F.col("i"), "left")
        values = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.coalesce(F.try_element_at("at", j), F.lit(0.0)))
        return self._new(rows.select(F.col("id").alias("row_idx"), values.alias("features")), sparse=False)

    def to_sparse(self) -> DsArray:
        return self if self.sparse else self._new(self.entries().filter("v <> 0"), sparse=True)

    def collect(self, squeeze: bool = True):
        """The values as a NumPy array; refused beyond ``LARGEST`` values."""
        n, m = self.shape
        if n * m > LARGEST * 8:
            raise ValueError(f"{n} x {m} values are too many to collect")
        out = np.zeros((n, m))
        if self.sparse:
            rows = self.df.toPandas()
            out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy()
        elif n and m:
            rows = self.df.select("row_idx", "features").toPandas()
            out[rows["row_idx"].to_numpy()] = stack(rows["features"], m)
        if squeeze:
            return out.item() if out.size == 1 else (out.reshape(-1) if 1 in out.shape else out)
        return out

    def copy(self) -> DsArray:
        return self._new(self.df)

    def rechunk(self, block_size: tuple[int, int]) -> DsArray:
        """Another block hint; values and plan stay as they are."""
        if self.sparse:
            raise NotImplementedError("rechunk of sparse arrays")
        _check_blocks(self.shape, block_size)
        return DsArray(self.df, self.shape, self.sparse, tuple(block_size))

    # -- indexing

    def __getitem__(self, index) -> DsArray:
        if isinstance(index, (int, np.integer)):
            return self._rows_of([_bounded(index, self.shape[0])])
        if isinstance(index, (list, np.ndarray)):
            return self._rows_of([_bounded(i, self.shape[0]) for i in index])
        if isinstance(index, slice):
            return self._row_slice(index)
        if not isinstance(index, tuple) or len(index) != 2:
            raise IndexError(f"invalid index {index!r}")
        rows, cols = index
        if isinstance(rows, (int, np.integer)) and isinstance(cols, (int, np.integer)):
            return self._rows_of([_bounded(rows, self.shape[0])])._cols_of([_bounded(cols, self.shape[1])])
        if isinstance(cols, (int, np.integer)):
            raise NotImplementedError("a single column is A[:, j:j+1]")
        out = self
        if isinstance(rows, slice):
            out = out._row_slice(rows)
        elif isinstance(rows, (list, np.ndarray)):
            out = out._rows_of([_bounded(i, self.shape[0]) for i in rows])
        elif isinstance(rows, (int, np.integer)):
            out = out._rows_of([_bounded(rows, self.shape[0])])
        else:
            raise IndexError(f"invalid index {index!r}")
        if isinstance(cols, slice):
            begin, end = _bounds(cols, self.shape[1])
            return out if (begin, end) == (0, self.shape[1]) else out._col_slice(begin, end)
        if isinstance(cols, (list, np.ndarray)):
            return out._cols_of([_bounded(j, self.shape[1]) for j in cols])
        raise IndexError(f"invalid index {index!r}")

    def _row_slice(self, rows: slice) -> DsArray:
        begin, end = _bounds(rows, self.shape[0])
        key = "i" if self.sparse else "row_idx"
        kept = self.df.filter((F.col(key) >= begin) & (F.col(key) < end)).withColumn(key, F.col(key) - F.lit(begin).cast("bigint"))
        return self._new(kept, (end - begin, self.shape[1]))

    def _col_slice(self, begin: int, end: int) -> DsArray:
        shape = (self.shape[0], end - begin)
        if self.sparse:
            return self._new(self.df.filter((F.col("j") >= begin) & (F.col("j") < end)).withColumn("j", F.col("j") - F.lit(begin).cast("bigint")), shape)
        return self._new(self.df.select("row_idx", F.slice("features", begin + 1, end - begin).alias("features")), shape)

    def _rows_of(self, rows: list[int]) -> DsArray:
        key = "i" if self.sparse else "row_idx"
        if len(set(rows)) == len(rows) <= 64:
            place = F.element_at(F.create_map(*[F.lit(v).cast("bigint") for k, i in enumerate(rows) for v in (i, k)]), F.col(key)) if rows else F.lit(0)
            kept = self.df.filter(F.col(key).isin(rows)).withColumn(key, place)
        else:
            picks = session().createDataFrame([(i, k) for k, i in enumerate(rows)], "__row bigint, __place bigint")
            kept = self.df.join(picks, F.col(key) == F.col("__row")).withColumn(key, F.col("__place")).drop("__row", "__place")
        return self._new(kept, (len(rows), self.shape[1]))

    def _cols_of(self, cols: list[int]) -> DsArray:
        shape = (self.shape[0], len(cols))
        if self.sparse:
            picks = session().createDataFrame([(j, k) for k, j in enumerate(cols)], "__col bigint, __place bigint")
            return self._new(self.df.join(picks, F.col("j") == F.col("__col")).select("i", F.col("__place").alias("j"), "v"), shape)
        return self._new(self.df.select("row_idx", F.transform(F.lit(cols), lambda j: F.get("features", j)).alias("features")), shape)

    def __setitem__(self, index, value) -> None:
        """``A[i, j] = s`` and ``A[a:b, j] = vector``; the handle is bound to the changed plan."""
        if not isinstance(index, tuple) or len(index) != 2 or not isinstance(index[1], (int, np.integer)):
            raise IndexError(f"invalid index {index!r}")
        rows, j = index[0], _bounded(index[1], self.shape[1])
        dense = self.to_dense()
        if isinstance(rows, (int, np.integer)):
            if not np.isscalar(value):
                raise ValueError("only a scalar can be set at one place")
            at = F.col("row_idx") == _bounded(rows, self.shape[0])
            put = F.transform("features", lambda x, k: F.when(k == j, F.lit(float(value))).otherwise(x))
            df = dense.df.select("row_idx", F.when(at, put).otherwise(F.col("features")).alias("features"))
        elif isinstance(rows, slice):
            begin, end = _bounds(rows, self.shape[0])
            vector = value if isinstance(value, DsArray) else array(np.asarray(value, float).reshape(-1, 1))
            if vector.shape != (end - begin, 1):
                raise ValueError(f"a column of {end - begin} values is needed")
            new = vector.to_dense().df.select((F.col("row_idx") + begin).alias("row_idx"), F.get("features", F.lit(0)).alias("__new"))
            both = dense.df.join(new, "row_idx", "left")
            inside = (F.col("row_idx") >= begin) & (F.col("row_idx") < end)
            put = F.transform("features", lambda x, k: F.when(k == j, F.col("__new")).otherwise(x))
            df = both.select("row_idx", F.when(inside, put).otherwise(F.col("features")).alias("features"))
        else:
            raise IndexError(f"invalid index {index!r}")
        self._plan = dense._new(df)._plan

    def delete(self, i: list[int] | None = None, j: list[int] | None = None) -> DsArray:
        """Without the given rows or columns, re-packed. Row numbers shift by the number of smaller deleted rows."""
        if i is None and j is None:
            raise ValueError("give rows or columns to delete")
        out = self.to_dense()
        if j is not None:
            gone = sorted({_bounded(x, self.shape[1]) for x in np.atleast_1d(j)})
            out = out._cols_of([k for k in range(self.shape[1]) if k not in set(gone)])
        if i is not None:
            gone = np.unique([_bounded(x, self.shape[0]) for x in np.atleast_1d(i)])
            shared = session().sparkContext.broadcast(gone)  # as large as the list given

            def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for p in parts:
                    rows = p["row_idx"].to_numpy("int64")
                    at = np.searchsorted(shared.value, rows)
                    kept = shared.value[np.minimum(at, len(shared.value) - 1)] != rows
                    yield p[kept].assign(row_idx=(rows - at)[kept])

            if len(gone):
                out = out._new(out.df.mapInPandas(run, "row_idx bigint, features array<double>"), (self.shape[0] - len(gone), out.shape[1]))
        return out

    def replace_block(self, bi: int, bj: int, block) -> DsArray:
        """With block (bi, bj) of the block hint replaced."""
        (h, w), (n, m) = self.block_size, self.shape
        block = np.asarray(block, float)
        if block.shape != (min(h, n - bi * h), min(w, m - bj * w)):
            raise ValueError("the block has another shape")
        new = array(block).df.select((F.col("row_idx") + bi * h).alias("row_idx"), F.col("features").alias("__new"))
        joined = self.to_dense().df.join(new, "row_idx", "left")
        left, right = F.slice("features", 1, bj * w), F.slice("features", bj * w + block.shape[1] + 1, m)
        features = F.when(F.col("__new").isNotNull(), F.concat(left, "__new", right)).otherwise(F.col("features"))
        return self._new(joined.select("row_idx", features.alias("features")), sparse=False)

    def transpose(self, mode: str = "auto") -> DsArray:
        """Swapped axes. A result of over ``LARGEST`` values in a row stays in entry form."""
        if mode not in ("auto", "rows", "columns", "all"):
            raise ValueError(f"unknown mode {mode!r}")
        swapped = self.entries().select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        shape = (self.shape[1], self.shape[0])
        if self.sparse or shape[1] > LARGEST:
            return DsArray(swapped, shape, True, self.block_size[::-1])
        rows = swapped.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("features"))
        return DsArray(rows.select(F.col("i").alias("row_idx"), "features"), shape, False, self.block_size[::-1])

    T = property(transpose)

    # -- elementwise

    def _row_vector(self, other) -> list[float]:
        if isinstance(other, DsArray):
            if other.shape != (1, self.shape[1]):
                raise NotImplementedError("matrices are combined with matadd and matsubtract")
            return np.atleast_1d(other.collect()).tolist()
        values = np.asarray(other, float).reshape(-1)
        if len(values) != self.shape[1]:
            raise ValueError("a row vector of as many columns is needed")
        return values.tolist()

    def _with_row(self, other, scalar: Callable, dense_only: bool = True) -> DsArray:
        base = self.to_dense() if dense_only else self
        if np.isscalar(other):
            return base._map(lambda x: scalar(x, F.lit(float(other))))
        row = base._row_vector(other)
        if base.sparse:
            return base._new(base.df.select("i", "j", scalar(F.col("v"), F.get(_lit_array(row), F.col("j").cast("int"))).alias("v")))
        return base._new(base.df.select("row_idx", F.zip_with("features", _lit_array(row), scalar).alias("features")))

    def _with_matrix(self, other: DsArray, f: Callable) -> DsArray:
        if self.shape != other.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape} differ")
        if self.sparse and other.sparse:
            a, b = self.df.select("i", "j", F.col("v").alias("a")), other.df.select("i", "j", F.col("v").alias("b"))
            both = a.join(b, ["i", "j"], "full")
            return self._new(both.select("i", "j", f(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("v")))
        a, b = self.to_dense(), other.to_dense()
        both = a.df.join(b.df.select("row_idx", F.col("features").alias("__other")), "row_idx")
        return self._new(both.select("row_idx", F.zip_with("features", "__other", f).alias("features")), sparse=False)

    def __add__(self, other) -> DsArray:
        return self._with_row(other, lambda x, y: x + y)

    __radd__ = __add__

    def __sub__(self, other) -> DsArray:
        return self._with_row(other, lambda x, y: x - y)

    def __iadd__(self, other) -> DsArray:
        if isinstance(other, DsArray) and other.shape[0] != 1:
            return self._with_matrix(other, lambda x, y: x + y)
        return self + other

    def __isub__(self, other) -> DsArray:
        if isinstance(other, DsArray) and other.shape[0] != 1:
            return self._with_matrix(other, lambda x, y: x - y)
        return self - other

    def __mul__(self, other) -> DsArray:
        return self._with_row(other, lambda x, y: x * y, dense_only=False)

    __rmul__ = __mul__

    def __truediv__(self, other) -> DsArray:
        if not np.isscalar(other):
            raise NotImplementedError("division by anything but a scalar")
        if other:
            return self._map(lambda x: x / F.lit(float(other)))
        inf = F.lit(math.inf)
        return self.to_dense()._map(lambda x: F.when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(math.nan)))

    def __pow__(self, power) -> DsArray:
        if not np.isscalar(power):
            raise NotImplementedError("powers other than scalars")
        base = self if power > 0 else self.to_dense()
        return base._map(lambda x: F.pow(x, F.lit(float(power))))

    def __ne__(self, other) -> DsArray:
        """1.0 where values differ, else 0.0."""

        def differ(x, y):
            return F.when(x != y, 1.0).otherwise(0.0)

        if isinstance(other, DsArray) and other.shape[0] != 1:
            return self._with_matrix(other, differ)
        return self._with_row(other, differ)

    __hash__ = object.__hash__

    def __matmul__(self, other: DsArray) -> DsArray:
        from blockframe.linalg import matmul

        if self.sparse != other.sparse:
            raise ValueError("both arrays must be dense, or both sparse")
        return matmul(self, other)

    def sqrt(self) -> DsArray:
        return self._map(F.sqrt)

    def conj(self) -> DsArray:
        """The values themselves: they are real. For complex columns see :func:`blockframe.functions.elementwise.conj`."""
        return self.copy()

    # -- reductions

    def _reduce(self, axis: int, name: str) -> DsArray:
        from blockframe.functions.reductions import by_column, by_row

        if axis not in (0, 1):
            raise ValueError("axis must be 0 or 1")
        if self.sparse and name in ("median", "norm"):
            raise NotImplementedError(f"{name} of sparse arrays")
        return (by_column if axis == 0 else by_row)(self, name)

    def min(self, axis: int = 0) -> DsArray:
        return self._reduce(axis, "min")

    def max(self, axis: int = 0) -> DsArray:
        return self._reduce(axis, "max")

    def sum(self, axis: int = 0) -> DsArray:
        return self._reduce(axis, "sum")

    def mean(self, axis: int = 0) -> DsArray:
        return self._reduce(axis, "mean")

    def median(self, axis: int = 0) -> DsArray:
        return self._reduce(axis, "median")

    def norm(self, axis: int = 0) -> DsArray:
        return self._reduce(axis, "norm")


def _bounded(i, n: int) -> int:
    if not 0 <= int(i) < n:
        raise IndexError(f"{i} is outside 0..{n - 1}")
    return int(i)


def _bounds(s: slice, n: int) -> tuple[int, int]:
    if s.step not in (None, 1) or (s.start or 0) < 0 or (s.stop is not None and s.stop < 0):
        raise NotImplementedError("slices with steps or negative bounds")
    begin, end = min(s.start or 0, n), min(n if s.stop is None else s.stop, n)
    return begin, max(begin, end)


def _check_blocks(shape: tuple[int, int], block_size) -> None:
    if block_size is not None and (block_size[0] > shape[0] or block_size[1] > shape[1]):
        raise ValueError(f"blocks {tuple(block_size)} are larger than {tuple(shape)}")


def _check_width(m: int) -> None:
    if m > LARGEST:
        raise ValueError(f"rows of {m} values are too wide for the dense form")


# -- creation


def array(x, block_size: tuple[int, int] | None = None) -> DsArray:
    """A distributed array of an in-memory matrix."""
    x = np.asarray(x, float)
    if x.ndim > 2:
        raise ValueError("at most two dimensions")
    if x.ndim < 2:
        if block_size is not None and 1 not in tuple(block_size):
            raise ValueError("a one-dimensional array needs blocks of one row or one column")
        x = x.reshape(-1, 1) if block_size is not None and block_size[1] == 1 and block_size[0] != 1 else x.reshape(1, -1)
    _check_blocks(x.shape, block_size)
    offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    rows = pa.table({"row_idx": pa.array(np.arange(len(x))), "features": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))})
    return DsArray(session().createDataFrame(rows), x.shape, False, block_size)


def from_rows(df: DataFrame, row_idx: str, features, n_rows: int | None = None, n_cols: int | None = None) -> DsArray:
    """A dense array over a DataFrame whose ``row_idx`` is dense from 0; ``features`` is an array column or a list of columns."""
    values = F.array(*[F.col(c).cast("double") for c in features]) if isinstance(features, (list, tuple)) else F.col(features).cast("array<double>")
    rows = df.select(F.col(row_idx).cast("bigint").alias("row_idx"), values.alias("features"))
    if n_cols is None:
        n_cols = len(features) if isinstance(features, (list, tuple)) else (rows.select(F.size("features")).first() or [0])[0]
    return DsArray(rows, (rows.count() if n_rows is None else n_rows, n_cols))


def from_entries(df: DataFrame, shape: tuple[int, int]) -> DsArray:
    """A sparse array over entries (i, j, v); repeated entries are summed, null and zero ones left out."""
    entries = df.filter("v IS NOT NULL").groupBy(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).agg(F.sum("v").alias("v"))
    return DsArray(entries.filter("v <> 0"), shape, True)


def random_array(shape: tuple[int, int], block_size: tuple[int, int] | None = None, random_state: int = 0) -> DsArray:
    """Uniform values in [0, 1), the same for a seed however the rows are partitioned."""
    _check_blocks(shape, block_size)
    seed = 0 if random_state is None else int(random_state)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            values = [np.random.Generator(np.random.Philox(key=[seed, int(i)])).random(shape[1]) for i in p["id"]]
            yield pd.DataFrame({"row_idx": p["id"], "features": values})

    df = session().range(shape[0]).mapInPandas(run, "row_idx bigint, features array<double>")
    return DsArray(df, shape, False, block_size)


def full(shape: tuple[int, int], fill_value: float, block_size: tuple[int, int] | None = None) -> DsArray:
    _check_blocks(shape, block_size)
    rows = session().range(shape[0]).select(F.col("id").alias("row_idx"), F.array_repeat(F.lit(float(fill_value)), shape[1]).alias("features"))
    return DsArray(rows, shape, False, block_size)


def zeros(shape: tuple[int, int], block_size: tuple[int, int] | None = None) -> DsArray:
    return full(shape, 0.0, block_size)


def eye(n: int, m: int, block_size: tuple[int, int] | None = None) -> DsArray:
    """Ones on the main diagonal."""
    _check_blocks((n, m), block_size)
    row = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.when(j == F.col("id"), 1.0).otherwise(0.0))
    return DsArray(session().range(n).select(F.col("id").alias("row_idx"), row.alias("features")), (n, m), False, block_size)


def identity(n: int, block_size: tuple[int, int] | None = None) -> DsArray:
    return eye(n, n, block_size)


# -- combination


def matadd(a: DsArray, b: DsArray) -> DsArray:
    return a._with_matrix(b, lambda x, y: x + y)


def matsubtract(a: DsArray, b: DsArray) -> DsArray:
    return a._with_matrix(b, lambda x, y: x - y)


def concat_rows(a: DsArray, b: DsArray) -> DsArray:
    """``b`` below ``a``."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("the numbers of columns differ")
    shape = (a.shape[0] + b.shape[0], a.shape[1])
    if a.sparse and b.sparse:
        return a._new(a.df.unionByName(b.df.withColumn("i", F.col("i") + a.shape[0])), shape)
    a, b = a.to_dense(), b.to_dense()
    return a._new(a.df.unionByName(b.df.withColumn("row_idx", F.col("row_idx") + a.shape[0])), shape)


def concat_columns(a: DsArray, b: DsArray) -> DsArray:
    """``b`` to the right of ``a``."""
    if a.shape[0] != b.shape[0]:
        raise ValueError("the numbers of rows differ")
    shape = (a.shape[0], a.shape[1] + b.shape[1])
    if a.sparse and b.sparse:
        return a._new(a.df.unionByName(b.df.withColumn("j", F.col("j") + a.shape[1])), shape)
    a, b = a.to_dense(), b.to_dense()
    both = a.df.join(b.df.select("row_idx", F.col("features").alias("__right")), "row_idx")
    return a._new(both.select("row_idx", F.concat("features", "__right").alias("features")), shape)


def pad(a: DsArray, widths: tuple[tuple[int, int], tuple[int, int]], constant_value: float = 0.0) -> DsArray:
    """Constant rows and columns around an array."""
    (top, bottom), (left, right) = widths
    n, m = a.shape
    side = [F.array_repeat(F.lit(float(constant_value)), k) for k in (left, right)]
    inner = a.to_dense().df.select((F.col("row_idx") + top).alias("row_idx"), F.concat(side[0], "features", side[1]).alias("features"))
    at = F.when(F.col("id") < top, F.col("id")).otherwise(F.col("id") + n)
    outer = session().range(top + bottom).select(at.alias("row_idx"), F.array_repeat(F.lit(float(constant_value)), left + m + right).alias("features"))
    return DsArray(inner.unionByName(outer), (n + top + bottom, m + left + right), False, a.block_size)


def bottom_right_shape(a: DsArray) -> tuple[int, int]:
    """Shape of the last block of the block hint."""
    return tuple(n - (-(-n // h) - 1) * h for n, h in zip(a.shape, a.block_size, strict=True))


def pad_last_blocks_with_zeros(a: DsArray) -> DsArray:
    """Zeros below and to the right up to whole blocks."""
    (h, w), (n, m) = a.block_size, a.shape
    return pad(a, ((0, -n % h), (0, -m % w)))


def remove_last_rows(a: DsArray, k: int) -> DsArray:
    return a[: a.shape[0] - k]


def remove_last_columns(a: DsArray, k: int) -> DsArray:
    return a[:, : a.shape[1] - k]


def load_blocks_rechunk(blocks: list[list], shape: tuple[int, int], block_size: tuple[int, int], new_block_size: tuple[int, int]) -> DsArray:
    """One array of a grid of blocks (arrays or in-memory matrices), with another block hint."""
    rows = []
    for line in blocks:
        parts = [b if isinstance(b, DsArray) else array(b) for b in line]
        out = parts[0]
        for p in parts[1:]:
            out = concat_columns(out, p)
        rows.append(out)
    out = rows[0]
    for r in rows[1:]:
        out = concat_rows(out, r)
    if out.shape != tuple(shape):
        raise ValueError(f"the blocks make {out.shape}, not {tuple(shape)}")
    return DsArray(out.df, out.shape, out.sparse, block_size).rechunk(new_block_size)


def apply_elementwise(func: Callable, a: DsArray) -> DsArray:
    """``func`` of the matrix of each Arrow batch of rows, of the same shape."""
    m = a.shape[1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield pd.DataFrame({"row_idx": p["row_idx"], "features": list(np.asarray(func(stack(p["features"], m)), float))})

    return a._new(a.to_dense().df.mapInPandas(run, "row_idx bigint, features array<double>"), sparse=False)


def apply_along_axis(func: Callable, axis: int, a: DsArray, *args, **kwargs) -> DsArray:
    """``func(matrix, *args, axis=axis, **kwargs)`` over whole columns (axis 0, result 1 x m) or rows (axis 1, result n x 1).

    Known NumPy reductions become partial aggregates. Any other function of axis 0 gets each column whole, in one task per column.
    """
    if axis not in (0, 1):
        raise ValueError("axis must be 0 or 1")
    known = {np.sum: "sum", np.mean: "mean", np.min: "min", np.max: "max", np.amin: "min", np.amax: "max", np.median: "median", np.linalg.norm: "norm"}
    if axis == 0 and not a.sparse:
        known |= {np.std: "std", np.var: "var"}
    if not args and not kwargs and func in known and not (a.sparse and known[func] in ("median", "norm")):
        return a._reduce(axis, known[func])
    n, m = a.shape
    dense = a.to_dense()
    if axis == 1:

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    out = np.asarray(func(stack(p["features"], m), *args, axis=1, **kwargs), float).reshape(-1, 1)
                    yield pd.DataFrame({"row_idx": p["row_idx"], "features": list(out)})

        return a._new(dense.df.mapInPandas(run, "row_idx bigint, features array<double>"), (n, 1), sparse=False)

    def column(p: pd.DataFrame) -> pd.DataFrame:
        values = p.sort_values("i")["v"].to_numpy(float).reshape(-1, 1)
        return pd.DataFrame({"j": [p["j"].iloc[0]], "v": [float(np.asarray(func(values, *args, axis=0, **kwargs)).reshape(-1)[0])]})

    out = dense.entries().groupBy("j").applyInPandas(column, "j bigint, v double")
    row = out.agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("features"))
    return a._new(row.select(F.lit(0).cast("bigint").alias("row_idx"), "features"), (1, m), sparse=False)
