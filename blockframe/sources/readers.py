"""Readers of numeric text, SVMLight, NumPy and trajectory files into arrays.

Text is read by splits; its row numbers come from the order of the input (file name, then offset), by counting lines per partition.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray, _check_blocks, session

#: Values of each line, values of each field and their width in the trajectory format (fixed values).
MDCRD_PER_LINE, MDCRD_WIDTH = 10, 8
#: Rows of a NumPy file that one task reads.
NPY_ROWS = 65_536


def numbered_lines(path: str) -> DataFrame:
    """(row_idx, value): lines of text files, blank ones left out, numbered in input order.

    Lines of a split come in order, so a split needs only the number of lines before it: one count of each split, no sort.
    """
    lines = session().read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.filter(F.trim("value") != "").withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    starts, total = [], 0
    for r in sorted(splits, key=lambda r: (r["file"], r["block"])):
        starts.append((r["file"], r["block"], total - r["first"]))
        total += r["n"]
    shift = session().createDataFrame(starts, "file string, block bigint, shift bigint")  # a row per split
    return lines.join(F.broadcast(shift), ["file", "block"]).select((F.col("id") + F.col("shift")).alias("row_idx"), "value")


def load_txt_file(path: str, block_size: tuple[int, int] | None = None, discard_first_row: bool = False, col_of_index: bool = False, delimiter: str = ",") -> DsArray:
    """Delimited numeric text. ``discard_first_row`` drops a header, ``col_of_index`` the first column; unreadable fields are NaN."""
    lines = numbered_lines(path)
    if discard_first_row:
        lines = lines.filter("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1)
    fields = F.split(F.trim("value"), f"\\Q{delimiter}\\E" if delimiter.strip() else r"\s+")
    if col_of_index:
        fields = F.slice(fields, 2, 1 << 30)
    values = F.transform(fields, lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(float("nan"))))
    rows = lines.select("row_idx", values.alias("features"))
    n, m = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    _check_blocks((n, m), block_size)
    return DsArray(rows, (n, m), False, block_size)


def load_svmlight_file(path: str, block_size: tuple[int, int] | None, n_features: int, store_sparse: bool = True, zero_based: bool | str = "auto") -> tuple[DsArray, DsArray]:
    """(x, y) of an SVMLight file. The index base is decided once over all lines: zero-based if any index is 0."""
    lines = numbered_lines(path)
    words = lines.select("row_idx", F.split(F.trim(F.split("value", "#")[0]), r"\s+").alias("w"))
    labels = words.select("row_idx", F.array(F.element_at("w", 1).cast("double")).alias("features"))
    pairs = words.select(F.col("row_idx").alias("i"), F.explode(F.slice("w", 2, 1 << 30)).alias("p")).filter(F.contains("p", F.lit(":")) & ~F.col("p").startswith("qid"))
    cells = pairs.select("i", F.split("p", ":")[0].cast("bigint").alias("j"), F.split("p", ":")[1].cast("double").alias("v"))
    base = 0 if zero_based is True else 1
    if zero_based == "auto" and cells.agg(F.min("j")).first()[0] == 0:
        base = 0
    n = lines.count()
    x = DsArray(cells.withColumn("j", F.col("j") - base).filter("v <> 0"), (n, n_features), True, block_size)
    _check_blocks(x.shape, block_size)
    return (x if store_sparse else x.to_dense()), DsArray(labels, (n, 1))


def _npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        if fortran:
            raise ValueError("Fortran order is not supported")
        return shape, dtype, f.tell()


def load_npy_file(path: str, block_size: tuple[int, int] | None = None) -> DsArray:
    """A two-dimensional C-order ``.npy`` file on a shared path, read by row ranges in parallel."""
    shape, dtype, offset = _npy_header(path)
    if len(shape) != 2:
        raise ValueError("the array must have two dimensions")
    _check_blocks(shape, block_size)
    n, m = shape
    width, name = m * dtype.itemsize, dtype.str

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "rb") as f:
            for p in parts:
                for begin in p["id"]:
                    k = min(NPY_ROWS, n - begin)
                    f.seek(offset + begin * width)
                    x = np.frombuffer(f.read(k * width), np.dtype(name)).reshape(k, m).astype(float)
                    yield pd.DataFrame({"row_idx": np.arange(begin, begin + k), "features": list(x)})

    starts = session().range(0, n, NPY_ROWS, numPartitions=max(1, -(-n // NPY_ROWS)))
    return DsArray(starts.mapInPandas(run, "row_idx bigint, features array<double>"), (n, m), False, block_size)


def _blocks(path: str) -> DataFrame:
    """(name, content) of the ``.npy`` files of a folder, on any file system that Spark reads."""
    files = session().read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _array_of(content: bytes) -> np.ndarray:
    x = np.load(io.BytesIO(content), allow_pickle=False)
    if x.ndim != 2:
        raise ValueError("the array must have two dimensions")
    return x


def _side_by_side(path: str, at: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows of blocks whose upper left corners are given, the pieces of a row joined by one shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, content in zip(p["name"], p["content"], strict=True):
                (top, left), x = at[name], _array_of(content).astype(float)
                for begin in range(0, len(x), 8192):
                    y = x[begin : begin + 8192]
                    yield pd.DataFrame({"row_idx": np.arange(len(y)) + top + begin, "left": left, "x": list(y)})

    pieces = _blocks(path).mapInPandas(run, "row_idx bigint, left bigint, x array<double>")
    if len({left for _, left in at.values()}) == 1:
        return pieces.select("row_idx", F.col("x").alias("features"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("left", "x"))), lambda e: e["x"])
    return pieces.groupBy("row_idx").agg(F.flatten(lines).alias("features"))


def _shapes(path: str) -> dict[str, tuple[int, int, str]]:
    """(rows, columns, type) of every block of a folder: one row per file on the driver."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [(name, *(x := _array_of(content)).shape, x.dtype.str) for name, content in zip(p["name"], p["content"], strict=True)]
            yield pd.DataFrame(found, columns=["name", "n", "m", "type"])

    return {r["name"]: (r["n"], r["m"], r["type"]) for r in _blocks(path).mapInPandas(run, "name string, n bigint, m bigint, type string").collect()}


def load_npy_files(path: str, shape: tuple[int, int] | None = None) -> DsArray:
    """A folder of ``i_j.npy`` blocks as one array of the given shape."""
    if shape is None:
        raise ValueError("shape is needed")
    shapes = _shapes(path)
    places = {name: tuple(map(int, name[:-4].split("_"))) for name in shapes}
    height = {i: shapes[name][0] for name, (i, _) in places.items()}
    width = {j: shapes[name][1] for name, (_, j) in places.items()}
    if any(shapes[name][:2] != (height[i], width[j]) for name, (i, j) in places.items()):
        raise ValueError("blocks of a row or column differ in size")
    top, left = ({k: sum(size[x] for x in size if x < k) for k in size} for size in (height, width))
    if (sum(height.values()), sum(width.values())) != tuple(shape):
        raise ValueError(f"the blocks make {sum(height.values())} x {sum(width.values())}, not {tuple(shape)}")
    return DsArray(_side_by_side(path, {name: (top[i], left[j]) for name, (i, j) in places.items()}), shape)


def load_hstack_npy_files(path: str, cols_per_block: int | None = None) -> DsArray:
    """A folder of ``.npy`` files with equal numbers of rows, side by side in alphabetical order."""
    shapes = _shapes(path)
    if len({(n, kind) for n, _, kind in shapes.values()}) != 1:
        raise ValueError("the files must have the same rows and type")
    at, m = {}, 0
    for name in sorted(shapes):
        at[name], m = (0, m), m + shapes[name][1]
    n = next(iter(shapes.values()))[0]
    return DsArray(_side_by_side(path, at), (n, m), False, (n, cols_per_block or m))


def load_mdcrd_file(path: str, block_size: tuple[int, int] | None, n_atoms: int, copy: bool = False) -> DsArray:
    """A molecular trajectory: one title line, then frames of ``3 * n_atoms`` fixed-width values. ``copy`` changes nothing here."""
    m = 3 * n_atoms
    per_frame = -(-m // MDCRD_PER_LINE)
    lines = numbered_lines(path).filter("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1)
    places = F.sequence(F.lit(0), F.floor((F.length(F.rtrim("value")) - 1) / MDCRD_WIDTH).cast("int"))
    values = F.transform(places, lambda k: F.trim(F.substring(F.col("value"), k * MDCRD_WIDTH + 1, F.lit(MDCRD_WIDTH))).cast("double"))
    frames = lines.select(F.floor(F.col("row_idx") / per_frame).alias("frame"), (F.col("row_idx") % per_frame).alias("k"), values.alias("x"))
    rows = frames.groupBy("frame").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"])).alias("features"))
    rows = rows.filter(F.size("features") == m).select(F.col("frame").alias("row_idx"), "features")
    n = rows.count()
    _check_blocks((n, m), block_size)
    return DsArray(rows, (n, m), False, block_size)


def npy_bytes(x: np.ndarray) -> bytes:
    """The ``.npy`` form of a matrix."""
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


__all__ = ["load_hstack_npy_files", "load_mdcrd_file", "load_npy_file", "load_npy_files", "load_svmlight_file", "load_txt_file"]
