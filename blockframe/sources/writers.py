"""Writers of arrays as text and NumPy files, one file per block (or block row), written by the tasks that hold the rows."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray
from blockframe.plans.index import stack


def _write(a: DsArray, directory: str, merge_rows: bool, name: Callable[[int, int], str], save: Callable) -> None:
    """Group rows by block row and let each group write its blocks; a file is renamed into place, so a repeated task does no harm."""
    os.makedirs(directory, exist_ok=True)
    (h, w), m = a.block_size, a.shape[1]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("row_idx")
        x, i = stack(p["features"], m), int(key[0])
        blocks = [(0, x)] if merge_rows else [(j, x[:, j * w : (j + 1) * w]) for j in range(-(-m // w))]
        for j, block in blocks:
            target = os.path.join(directory, name(i, j))
            part = f"{target}.{os.getpid()}.part"
            save(part, block)
            os.replace(part, target)
        return pd.DataFrame({"files": [len(blocks)]})

    rows = a.to_dense().df.withColumn("__block", F.floor(F.col("row_idx") / h))
    rows.groupBy("__block").applyInPandas(run, "files int").agg(F.sum("files")).collect()


def _save_npy(path: str, x: np.ndarray) -> None:
    with open(path, "wb") as f:
        np.save(f, x)


def save_txt(a: DsArray, directory: str, merge_rows: bool = False) -> None:
    """Text files ``i_j`` of the blocks, or ``i`` of the block rows, values separated by spaces."""
    _write(a, directory, merge_rows, (lambda i, j: str(i)) if merge_rows else (lambda i, j: f"{i}_{j}"), np.savetxt)


def save_npy_file(a: DsArray, directory: str, merge_rows: bool = False) -> None:
    """``.npy`` files ``i_j.npy`` of the blocks, or ``i.npy`` of the block rows."""
    _write(a, directory, merge_rows, (lambda i, j: f"{i}.npy") if merge_rows else (lambda i, j: f"{i}_{j}.npy"), _save_npy)
