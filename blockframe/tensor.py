"""Distributed grids of equally shaped tensors.

A :class:`Tensor` is rows ``(ti, tj, sample_idx, data ARRAY<DOUBLE>)``: one row for each sample of the tensor at grid place (ti, tj), its
values flattened. Elementwise work and indexing stay in built-in expressions; torch payloads need torch.
"""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray, session
from blockframe.operators.ordering import hash_order
from blockframe.plans.index import dense_index, stack


def _torch():
    try:
        return importlib.import_module("torch")
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError("this needs the torch package") from e


class Tensor:
    """``shape`` is the grid, ``tensor_shape`` the shape of each tensor, its first axis the samples."""

    def __init__(self, df: DataFrame, shape: tuple[int, int], tensor_shape: tuple[int, ...]):
        self.df, self.shape, self.tensor_shape = df, tuple(shape), tuple(int(s) for s in tensor_shape)

    number_samples = property(lambda self: self.shape[0] * self.tensor_shape[0])
    n_tensors = property(lambda self: self.shape[0] * self.shape[1])
    dtype = property(lambda self: np.dtype(float))

    def _with(self, data, df: DataFrame | None = None) -> Tensor:
        return Tensor((df or self.df).select("ti", "tj", "sample_idx", data.alias("data")), self.shape, self.tensor_shape)

    def _combine(self, other, f: Callable) -> Tensor:
        if np.isscalar(other):
            return self._with(F.transform("data", lambda v: f(v, F.lit(float(other)))))
        if not isinstance(other, Tensor) or other.shape != self.shape or other.tensor_shape != self.tensor_shape:
            raise ValueError("shapes differ")
        both = self.df.join(other.df.withColumnRenamed("data", "__other"), ["ti", "tj", "sample_idx"])
        return self._with(F.zip_with("data", "__other", f), both)

    def __add__(self, other) -> Tensor:
        return self._combine(other, lambda a, b: a + b)

    def __sub__(self, other) -> Tensor:
        return self._combine(other, lambda a, b: a - b)

    def _scalar(self, other, f: Callable) -> Tensor:
        if not np.isscalar(other):
            raise NotImplementedError("only scalars")
        return self._combine(other, f)

    def __mul__(self, other) -> Tensor:
        return self._scalar(other, lambda a, b: a * b)

    def __truediv__(self, other) -> Tensor:
        return self._scalar(other, lambda a, b: a / F.when(b != 0, b))

    def __pow__(self, other) -> Tensor:
        return self._scalar(other, lambda a, b: F.pow(a, b))

    def __getitem__(self, index) -> Tensor:
        """Grid places: ``t[i]``, ``t[i, j]``, and slices without steps."""
        index = index if isinstance(index, tuple) else (index,)
        bounds = []
        for k in range(2):
            i, n = (index[k] if k < len(index) else slice(None)), self.shape[k]
            if isinstance(i, slice):
                if i.step not in (None, 1):
                    raise NotImplementedError("slices with steps")
                begin, end, _ = i.indices(n)
            else:
                if not 0 <= i < n:
                    raise IndexError(f"{i} is outside 0..{n - 1}")
                begin, end = i, i + 1
            bounds.append((begin, max(begin, end)))
        (a, b), (c, d) = bounds
        kept = self.df.filter((F.col("ti") >= a) & (F.col("ti") < b) & (F.col("tj") >= c) & (F.col("tj") < d))
        return Tensor(kept.withColumns({"ti": F.col("ti") - a, "tj": F.col("tj") - c}), (b - a, d - c), self.tensor_shape)

    def __setitem__(self, index: tuple[int, int], value) -> None:
        i, j = index
        new = from_array(np.asarray(value, float).reshape((1, 1, *self.tensor_shape)), (1, 1)).df.withColumns({"ti": F.lit(int(i)), "tj": F.lit(int(j))})
        self.df = self.df.filter((F.col("ti") != i) | (F.col("tj") != j)).unionByName(new)

    def apply_to_tensors(self, func: Callable[[np.ndarray], np.ndarray]) -> Tensor:
        """``func`` of each tensor, whole, giving the same number of samples."""
        shape, tail = self.tensor_shape, None

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("sample_idx")
            out = np.asarray(func(stack(p["data"]).reshape(shape)), float)
            return p.assign(data=list(out.reshape(shape[0], -1)))

        probe = np.asarray(func(np.zeros(shape)), float).shape
        tail = probe if probe and probe[0] == shape[0] else shape
        out = self.df.groupBy("ti", "tj").applyInPandas(run, "ti int, tj int, sample_idx bigint, data array<double>")
        return Tensor(out, self.shape, tail)

    def collect(self) -> list[list[np.ndarray]]:
        rows = self.df.toPandas().sort_values(["ti", "tj", "sample_idx"])
        out = [[np.zeros(self.tensor_shape) for _ in range(self.shape[1])] for _ in range(self.shape[0])]
        for (i, j), p in rows.groupby(["ti", "tj"]):
            out[i][j] = stack(p["data"]).reshape(self.tensor_shape)
        return out


def from_array(x: np.ndarray, shape: tuple[int, int]) -> Tensor:
    """A grid of an array whose first axes are the grid, or whose samples are cut into ``shape[0]`` equal parts."""
    x = np.asarray(x, float)
    if x.shape[:2] != tuple(shape):
        if len(x) % shape[0] or shape[1] != 1:
            raise ValueError("the samples do not divide evenly over the grid")
        x = x.reshape((shape[0], 1, len(x) // shape[0], *x.shape[1:]))
    n, (rows, columns), samples = int(np.prod(x.shape[:3])), shape, x.shape[2]
    at, flat = np.arange(n), np.ascontiguousarray(x).reshape(n, -1)
    data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
    place = {"ti": pa.array(at // (columns * samples), pa.int32()), "tj": pa.array(at // samples % columns, pa.int32()), "sample_idx": pa.array(at % samples)}
    return Tensor(session().createDataFrame(pa.table({**place, "data": data})), shape, x.shape[2:])


create_ds_tensor = from_array


def from_pt_tensor(x, shape: tuple[int, int]) -> Tensor:
    _torch()
    return from_array(x.detach().cpu().numpy(), shape)


def from_ds_array(a: DsArray, tensor_shape: tuple[int, ...] | None = None) -> Tensor:
    """Row blocks of an array as tensors; ``tensor_shape`` reshapes each row block."""
    h, (n, m) = a.block_size[0], a.shape
    if n % h:
        raise ValueError("the rows do not divide evenly into blocks")
    shape = tuple(tensor_shape or (h, m))
    if int(np.prod(shape)) != h * m or shape[0] != h:
        raise ValueError("tensor_shape must keep the rows and the number of values of a block")
    df = a.to_dense().df.select(F.floor(F.col("row_idx") / h).cast("int").alias("ti"), F.lit(0).alias("tj"), (F.col("row_idx") % h).alias("sample_idx"), F.col("features").alias("data"))
    return Tensor(df, (n // h, 1), shape)


def random_tensors(kind: str, shape: tuple[int, int], tensor_shape: tuple[int, ...], random_state: int = 0) -> Tensor:
    """Uniform values; ``kind`` is "np" or "torch"."""
    if kind not in ("np", "torch"):
        raise ValueError("kind must be np or torch")
    if kind == "torch":
        _torch()
    samples, size = int(tensor_shape[0]), int(np.prod(tensor_shape[1:]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            data = [np.random.Generator(np.random.Philox(key=[random_state, int(i)])).random(size) for i in p["id"]]
            block = p["id"] // samples
            yield pd.DataFrame({"ti": (block // shape[1]).astype("int32"), "tj": (block % shape[1]).astype("int32"), "sample_idx": p["id"] % samples, "data": data})

    df = session().range(shape[0] * shape[1] * samples).mapInPandas(run, "ti int, tj int, sample_idx bigint, data array<double>")
    return Tensor(df, shape, tensor_shape)


def cat(tensors: list[Tensor], dimension: int = 0) -> Tensor:
    """Grids joined along dimension 0 or 1."""
    if dimension not in (0, 1) or len({(t.shape[1 - dimension], t.tensor_shape) for t in tensors}) != 1:
        raise ValueError("grids of equal tensors, joined along 0 or 1, are needed")
    key, at, out = ("ti", "tj")[dimension], 0, None
    for t in tensors:
        moved = t.df.withColumn(key, F.col(key) + at)
        out, at = (moved if out is None else out.unionByName(moved)), at + t.shape[dimension]
    shape = (at, tensors[0].shape[1]) if dimension == 0 else (tensors[0].shape[0], at)
    return Tensor(out, shape, tensors[0].tensor_shape)


def change_shape(t: Tensor, tensor_shape: tuple[int, ...]) -> Tensor:
    """Another shape of each sample; values keep their order."""
    if tensor_shape[0] != t.tensor_shape[0] or int(np.prod(tensor_shape)) != int(np.prod(t.tensor_shape)):
        raise ValueError("samples and number of values must stay")
    return Tensor(t.df, t.shape, tensor_shape)


def _regrid(df: DataFrame, number, samples: int, width: int) -> DataFrame:
    """Rows numbered along ``ti`` cut into tensors of ``samples`` samples."""
    return df.select(F.floor(number / samples).cast("int").alias("ti"), "tj", (number % samples).cast("bigint").alias("sample_idx"), "data")


def rechunk_tensor(t: Tensor, samples: int, dimension: int = 0) -> Tensor:
    """The same samples in tensors of another number of samples."""
    if dimension != 0 or t.number_samples % samples:
        raise ValueError("samples must divide evenly along dimension 0")
    number = F.col("ti") * t.tensor_shape[0] + F.col("sample_idx")
    return Tensor(_regrid(t.df, number, samples, t.shape[1]), (t.number_samples // samples, t.shape[1]), (samples, *t.tensor_shape[1:]))


def shuffle(x: Tensor, y: Tensor | None = None, random_state: int = 0):
    """Samples in a random order over the grid, the same for x and y."""

    def permuted(t: Tensor) -> Tensor:
        number = F.col("ti") * t.tensor_shape[0] + F.col("sample_idx")
        places = session().range(t.number_samples).select(F.col("id").alias("old"))
        places = dense_index(places, [hash_order(F.col("old"), random_state), F.col("old")], "new")
        moved = t.df.withColumn("old", number).join(places, "old")
        return Tensor(_regrid(moved, F.col("new"), t.tensor_shape[0], t.shape[1]), t.shape, t.tensor_shape)

    return permuted(x) if y is None else (permuted(x), permuted(y))


def load_dataset(number_tensors_per_file: int, path: str) -> Tensor:
    """A folder of ``.npy`` (or ``.pt``, with torch) files in alphabetical order, each cut into ``number_tensors_per_file`` tensors.

    Files are read by the tasks, on any file system that Spark reads; the driver gets a name and a shape of each.
    """
    k = number_tensors_per_file
    try:
        found = session().read.format("binaryFile").load(path)
    except AnalysisException as e:
        raise NotImplementedError("only .npy and .pt files are read, and there are none") from e
    files = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    kinds = {r["kind"] for r in files.select(F.element_at(F.split("name", r"\."), -1).alias("kind")).distinct().collect()}
    kind = next((x for x in ("npy", "pt") if x in kinds), None)
    if kind is None:
        raise NotImplementedError("only .npy and .pt files are read")
    if kind == "pt":
        _torch()
    files = files.filter(F.col("name").endswith(f".{kind}"))

    def read(content: bytes) -> np.ndarray:
        x = np.load(io.BytesIO(content), allow_pickle=False) if kind == "npy" else _torch().load(io.BytesIO(content)).numpy()
        if len(x) % k:
            raise ValueError("the samples do not divide evenly over the tensors of a file")
        return np.asarray(x, float)

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"name": p["name"], "shape": [list(read(c).shape) for c in p["content"]]})

    found = {r["name"]: tuple(r["shape"]) for r in files.mapInPandas(shapes, "name string, shape array<bigint>").collect()}
    if len(set(found.values())) != 1:
        raise ValueError("the files must have the same shape")
    order, shape = {name: i for i, name in enumerate(sorted(found))}, next(iter(found.values()))
    samples = shape[0] // k

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, content in zip(p["name"], p["content"], strict=True):
                x, at = read(content), np.arange(shape[0])
                yield pd.DataFrame({"ti": (at // samples + order[name] * k).astype("int32"), "tj": np.zeros(len(at), "int32"), "sample_idx": at % samples, "data": list(x.reshape(len(x), -1))})

    return Tensor(files.mapInPandas(rows, "ti int, tj int, sample_idx bigint, data array<double>"), (len(order) * k, 1), (samples, *shape[1:]))
