"""Queries that write whole tables as files, read them back, and work on tensors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe import dsarray as A
from blockframe import tensor as T
from blockframe.cluster import KMeans
from blockframe.plans.runtime import shared_dir, table
from blockframe.queries.arrays import embeddings, long
from blockframe.sources import readers, writers

FRAME = 36


def folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach."""
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def local(path: str) -> str:
    """The path as the file system of a shared mount knows it."""
    return path.removeprefix("file://").removeprefix("file:")


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as delimited text, with a header and a column of row numbers."""
    at, x = folder(spark), embeddings(spark, sf_dir)
    lines = x.df.select("row_idx", F.concat_ws(";", F.col("row_idx").cast("string"), F.array_join(F.transform("features", lambda v: v.cast("string")), ";")).alias("value"))
    head = spark.createDataFrame([(-1, ";".join(["row", *[f"x{k}" for k in range(x.shape[1])]]))], "row_idx bigint, value string")
    head.unionByName(lines).orderBy("row_idx").select("value").write.text(at)
    return long(readers.load_txt_file(at, discard_first_row=True, col_of_index=True, delimiter=";"))


def _saved_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings through the text writer: one file, values apart by spaces."""
    at, x = folder(spark), embeddings(spark, sf_dir)
    writers.save_txt(x, local(at), merge_rows=True)
    return long(readers.load_txt_file(at, delimiter=" "))


def _svmlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """libsvm_entries and libsvm_labels as SVMLight lines, read back sparse; a null label is written as nan."""
    at = folder(spark)
    cells = table(spark, sf_dir, "libsvm_entries").filter("v IS NOT NULL").groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v <> 0")
    words = cells.groupBy("i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda e: F.concat(e["j"].cast("string"), F.lit(":"), e["v"].cast("string"))), " ").alias("w"))
    labels = table(spark, sf_dir, "libsvm_labels").select(F.col("row_idx").alias("i"), F.coalesce(F.col("label").cast("string"), F.lit("NaN")).alias("label"))
    labels.join(words, "i", "left").orderBy("i").select(F.concat_ws(" ", "label", "w").alias("value")).write.text(at)
    x, _ = readers.load_svmlight_file(at, None, 780)
    return long(x, 9)


def _npy(merge: bool) -> Callable[[SparkSession, str], DataFrame]:
    """embeddings as a grid of ``.npy`` blocks, or as blocks of columns side by side."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at, x = folder(spark), embeddings(spark, sf_dir)
        writers.save_npy_file(x.rechunk((x.shape[0] if merge else max(1, x.shape[0] // 3), 16)), local(at))
        return long(readers.load_hstack_npy_files(at, 16) if merge else readers.load_npy_files(at, x.shape))

    return run


def _npy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one ``.npy`` file."""
    at, x = folder(spark), embeddings(spark, sf_dir)
    writers.save_npy_file(x, local(at), merge_rows=True)
    return long(readers.load_npy_file(f"{local(at)}/0.npy"))


def _trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames as a trajectory file of fixed width, read back in their order."""
    at = folder(spark)
    frames = table(spark, sf_dir, "traj_frames").filter(F.size("features") == FRAME).select("row_idx", F.transform("features", lambda v: F.lpad(F.format_string("%.3f", v), readers.MDCRD_WIDTH, " ")).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.lit((FRAME - 1) // readers.MDCRD_PER_LINE)), lambda k: F.array_join(F.slice("w", k * readers.MDCRD_PER_LINE + 1, F.lit(readers.MDCRD_PER_LINE)), ""))
    lines = frames.select("row_idx", F.posexplode(cut).alias("k", "value"))
    title = spark.createDataFrame([(-1, 0, "title")], "row_idx bigint, k int, value string")
    title.unionByName(lines).orderBy("row_idx", "k").select("value").write.text(at)
    return long(readers.load_mdcrd_file(at, None, FRAME // 3), 3)


def _grid(spark: SparkSession, sf_dir: str) -> T.Tensor:
    """embeddings as tensors of ten rows of 8 x 8 values each; the number of rows is a multiple of ten."""
    x = embeddings(spark, sf_dir)
    return T.from_ds_array(x.rechunk((10, x.shape[1])), (10, 8, 8))


def _cells(t: T.Tensor) -> DataFrame:
    """(ti, tj, s, k, v) of a grid."""
    rows = t.df.select("ti", "tj", F.col("sample_idx").alias("s"), F.posexplode("data").alias("k", "v"))
    return rows.select("ti", "tj", "s", "k", (F.round("v", 6) + F.lit(0.0)).alias("v"))


def _on_grid(f: Callable[[T.Tensor], T.Tensor]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _cells(f(_grid(spark, sf_dir)))


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings in one ``.npy`` file, read as two tensors."""
    at, x = folder(spark), embeddings(spark, sf_dir)
    writers.save_npy_file(x, local(at), merge_rows=True)
    return _cells(T.load_dataset(2, at))


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a saved and loaded model, which are those of the model itself."""
    import numpy as np

    at, x = f"{local(folder(spark))}.json", embeddings(spark, sf_dir)
    model = KMeans(4, init=np.asarray(x[0:4].collect(squeeze=False)), max_iter=3, tol=0).fit(x)
    model.save_model(at)
    a, b = (m.predict(x).df for m in (model, KMeans.load_model(at)))
    return a.join(b.withColumnRenamed("features", "other"), "row_idx").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("features") != F.col("other"), 1)).alias("differ"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "io_text": _text,
    "io_saved_text": _saved_text,
    "io_svmlight": _svmlight,
    "io_npy_blocks": _npy(False),
    "io_npy_columns": _npy(True),
    "io_npy_file": _npy_file,
    "io_trajectory": _trajectory,
    "io_model": _model,
    "array_random": lambda spark, sf_dir: A.random_array((200, 5)).df.select(F.explode("features").alias("v")).agg(F.count("v").alias("n"), F.count(F.when((F.col("v") < 0) | (F.col("v") >= 1), 1)).alias("outside")),
    "tensor_grid": _on_grid(lambda t: t),
    "tensor_add": _on_grid(lambda t: t + t),
    "tensor_scale": _on_grid(lambda t: t * 2.5),
    "tensor_cat": _on_grid(lambda t: T.cat([t, t])),
    "tensor_rechunk": _on_grid(lambda t: T.rechunk_tensor(t, 5)),
    "tensor_reshape": _on_grid(lambda t: T.change_shape(t, (10, 64))),
    "tensor_shuffle": lambda spark, sf_dir: _cells(T.shuffle(_grid(spark, sf_dir), random_state=3)).groupBy("k").agg(F.count("v").alias("n"), F.round(F.sum("v"), 6).alias("total")),
    "tensor_dataset": _dataset,
}

_M = "m AS (SELECT vec_id AS i, generate_subscripts(embedding, 1)::BIGINT - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_SAME = f"WITH {_M} SELECT i, j, round(v, 6) + 0.0 AS v FROM m"


def _tensor(value: str = "v", grid: str = "i // 10", sample: str = "i % 10", source: str = "m") -> str:
    return f"WITH {_M} SELECT ({grid})::INT AS ti, 0::INT AS tj, {sample} AS s, j::INT AS k, round({value}, 6) + 0.0 AS v FROM {source}"


ORACLES = {
    "io_text": _SAME,
    "io_saved_text": _SAME,
    "io_npy_blocks": _SAME,
    "io_npy_columns": _SAME,
    "io_npy_file": _SAME,
    "io_svmlight": """WITH r AS (SELECT row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS i FROM libsvm_labels),
        s AS (SELECT i AS row_idx, j - 1 AS j, sum(v) AS v FROM libsvm_entries WHERE v IS NOT NULL GROUP BY i, j HAVING sum(v) <> 0)
        SELECT r.i, s.j, round(s.v, 9) + 0.0 AS v FROM s JOIN r ON r.row_idx = s.row_idx""",
    "io_trajectory": f"""WITH f AS (SELECT row_number() OVER (ORDER BY row_idx) - 1 AS i, features FROM traj_frames WHERE len(features) = {FRAME}),
        c AS (SELECT i, generate_subscripts(features, 1)::BIGINT - 1 AS j, unnest(features) AS v FROM f) SELECT i, j, round(v, 3) + 0.0 AS v FROM c""",
    "io_model": "SELECT count(*) AS rows, 0::BIGINT AS differ FROM embeddings",
    "array_random": "SELECT 1000::BIGINT AS n, 0::BIGINT AS outside",
    "tensor_grid": _tensor(),
    "tensor_add": _tensor("v + v"),
    "tensor_scale": _tensor("v * 2.5"),
    "tensor_cat": _tensor(grid="i // 10 + c * ((SELECT count(*) FROM embeddings) // 10)", source="m, (VALUES (0), (1)) t(c)"),
    "tensor_rechunk": _tensor(grid="i // 5", sample="i % 5"),
    "tensor_reshape": _tensor(),
    "tensor_shuffle": f"WITH {_M} SELECT j::INT AS k, count(*) AS n, round(sum(round(v, 6)), 6) AS total FROM m GROUP BY j",
    "tensor_dataset": _tensor(grid="i // ((SELECT count(*) FROM embeddings) // 2)", sample="i % ((SELECT count(*) FROM embeddings) // 2)"),
}
