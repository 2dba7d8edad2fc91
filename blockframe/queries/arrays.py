"""Queries of array creation, indexing, elementwise work, reductions and products, over whole tables.

Results come in long form (i, j, v) with values rounded to 6 places, so that engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe import dsarray as A
from blockframe import linalg
from blockframe.functions import elementwise
from blockframe.operators.ordering import KFold, TeraSort, shuffle, train_test_split
from blockframe.plans.runtime import table


def embeddings(spark: SparkSession, sf_dir: str) -> A.DsArray:
    rows = table(spark, sf_dir, "embeddings")
    return A.from_rows(rows, "vec_id", "embedding")


def labels(spark: SparkSession, sf_dir: str) -> A.DsArray:
    return A.from_rows(table(spark, sf_dir, "embeddings"), "vec_id", ["label"])


def libsvm(spark: SparkSession, sf_dir: str) -> A.DsArray:
    """The sparse matrix of libsvm_entries: columns from 0, repeated entries summed, null and zero values absent."""
    entries = table(spark, sf_dir, "libsvm_entries").select("i", (F.col("j") - 1).alias("j"), "v")
    n = (entries.agg(F.max("i")).first()[0] or 0) + 1
    return A.from_entries(entries, (n, 780))


def long(a: A.DsArray, digits: int = 6) -> DataFrame:
    return a.entries().select("i", F.col("j").cast("bigint").alias("j"), (F.round("v", digits) + F.lit(0.0)).alias("v"))


def _on_embeddings(f: Callable[[A.DsArray], A.DsArray]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: long(f(embeddings(spark, sf_dir)))


def _on_libsvm(f: Callable[[A.DsArray], A.DsArray]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: long(f(libsvm(spark, sf_dir)).to_sparse(), 9)  # quotients of 6-place values: no ties at 9 places


def _set_item(a: A.DsArray) -> A.DsArray:
    b = a.copy()
    b[2, 3] = 7.5
    return b


def _set_column(a: A.DsArray) -> A.DsArray:
    b = a.copy()
    b[0 : a.shape[0], 1] = a[:, 0:1]
    return b


def _add_in_place(a: A.DsArray) -> A.DsArray:
    b = a.copy()
    b += a * 2
    return b


def _kron(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = A.from_rows(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"])
    region = A.from_rows(table(spark, sf_dir, "region").withColumn("two", F.col("r_regionkey") + 2), "r_regionkey", ["r_regionkey", "two"])
    return long(linalg.kron(nation, region))


def _shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = shuffle(embeddings(spark, sf_dir), labels(spark, sf_dir), random_state=7)
    v = x.df.select("row_idx", F.round(F.get("features", F.lit(0)), 6).alias("v"))
    return v.join(y.df.select("row_idx", F.get("features", F.lit(0)).alias("label")), "row_idx")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = train_test_split(embeddings(spark, sf_dir), test_size=0.25, random_state=7, block_rows=100)
    named = [p.df.select(F.lit(name).alias("part"), "row_idx", F.round(F.get("features", F.lit(0)), 6).alias("v")) for p, name in zip(parts, ("train", "test"), strict=True)]
    return named[0].unionByName(named[1])


def _kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for k, ((train, _), (test, _)) in enumerate(KFold(4).split(embeddings(spark, sf_dir))):
        for part, name in ((train, "train"), (test, "test")):
            one = part.df.select(F.lit(k).alias("fold"), F.lit(name).alias("part"), "row_idx", F.round(F.get("features", F.lit(0)), 6).alias("v"))
            out = one if out is None else out.unionByName(one)
    return out


def _trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean place of every coordinate over the whole frames; null and short frames are no frames."""
    frames = table(spark, sf_dir, "traj_frames").filter(F.size("features") == 36)
    return long(A.from_rows(frames, "row_idx", "features", n_cols=36).mean(0))


_STATS = ("sum", "min", "max", "mean", "median", "norm")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"arr_{s}_axis{axis}": _on_embeddings(lambda a, s=s, axis=axis: getattr(a, s)(axis)) for s in _STATS for axis in (0, 1)},
    **{f"sparse_{s}_axis{axis}": _on_libsvm(lambda a, s=s, axis=axis: getattr(a, s)(axis)) for s in ("sum", "min", "max", "mean") for axis in (0, 1)},
    "arr_add_scalar": _on_embeddings(lambda a: a + 2.5),
    "arr_sub_rowvec": _on_embeddings(lambda a: a - a.mean(0)),
    "arr_mul_scalar": _on_embeddings(lambda a: a * 3.0),
    "arr_mul_rowvec": _on_embeddings(lambda a: a * a.max(0)),
    "arr_div_scalar": _on_embeddings(lambda a: a / 4.0),
    "arr_pow": _on_embeddings(lambda a: a**2),
    "arr_sqrt": _on_embeddings(lambda a: (a**2).sqrt()),
    "arr_exp": _on_embeddings(elementwise.exp),
    "arr_log": _on_embeddings(lambda a: elementwise.log(a**2 + 1.0)),
    "arr_gammaln": _on_embeddings(lambda a: elementwise.gammaln(a**2 + 1.0)),
    "arr_ne": _on_embeddings(lambda a: a != a.min(0)),
    "arr_iadd": _on_embeddings(_add_in_place),
    "arr_slice_rows": _on_embeddings(lambda a: a[10:30]),
    "arr_slice_cols": _on_embeddings(lambda a: a[:, 5:9]),
    "arr_slice_both": _on_embeddings(lambda a: a[10:30, 5:9]),
    "arr_list_rows": _on_embeddings(lambda a: a[[7, 3, 19]]),
    "arr_list_cols": _on_embeddings(lambda a: a[:, [9, 0, 4]]),
    "arr_get_item": _on_embeddings(lambda a: a[4, 6]),
    "arr_set_item": _on_embeddings(_set_item),
    "arr_set_column": _on_embeddings(_set_column),
    "arr_delete": _on_embeddings(lambda a: a.delete(i=[0, 5], j=[1, 63])),
    "arr_transpose": _on_embeddings(lambda a: a.T),
    "arr_concat_rows": _on_embeddings(lambda a: A.concat_rows(a, a)),
    "arr_concat_columns": _on_embeddings(lambda a: A.concat_columns(a, a)),
    "arr_rechunk": _on_embeddings(lambda a: a.rechunk((50, 16))),
    "arr_pad": _on_embeddings(lambda a: A.pad(a, ((1, 2), (0, 3)), -1.0)),
    "arr_zeros_full": lambda spark, sf_dir: long(A.concat_rows(A.zeros((3, 4)), A.full((2, 4), 1.5))),
    "arr_eye": lambda spark, sf_dir: long(A.eye(4, 6)),
    "arr_identity": lambda spark, sf_dir: long(A.identity(5)),
    "arr_apply_std_axis0": _on_embeddings(lambda a: A.apply_along_axis(np.std, 0, a)),
    "arr_apply_std_axis1": _on_embeddings(lambda a: A.apply_along_axis(np.std, 1, a)),
    "arr_apply_elementwise": _on_embeddings(lambda a: A.apply_elementwise(np.square, a)),
    "matadd": _on_embeddings(lambda a: A.matadd(a, a * 2)),
    "matsubtract": _on_embeddings(lambda a: A.matsubtract(a, a * 2)),
    "matmul_ab": _on_embeddings(lambda a: linalg.matmul(a, A.eye(64, 8) + 1.0)),
    "matmul_gram": _on_embeddings(lambda a: linalg.matmul(a, a, transpose_a=True)),
    "matmul_a_bt": _on_embeddings(lambda a: linalg.matmul(a, a, transpose_b=True)),
    "matmul_tiles": _on_embeddings(lambda a: linalg.tile_matmul(a, A.eye(64, 8) + 1.0)),
    "kron": _kron,
    "sparse_transpose": _on_libsvm(lambda a: a.T),
    "sparse_scale": _on_libsvm(lambda a: a * 3.0),
    "sparse_gram": _on_libsvm(lambda a: linalg.matmul(a, a, transpose_b=True)),
    "trajectory_mean": _trajectory,
    "terasort_values": _on_embeddings(lambda a: TeraSort(-1e9, 1e9).sort(a)),
    "terasort_columns": _on_embeddings(lambda a: TeraSort([-1e9] * 3, [1e9] * 3, column_indexes=[0, 5, 9]).sort(a)),
    "shuffle_hash": _shuffle,
    "train_test_split_hash": _split,
    "kfold": _kfold,
}

_M = "m AS (SELECT vec_id AS i, generate_subscripts(embedding, 1)::BIGINT - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_S = """s AS (SELECT i, j - 1 AS j, sum(v) AS v FROM libsvm_entries WHERE v IS NOT NULL GROUP BY i, j HAVING sum(v) <> 0),
    n AS (SELECT max(i) + 1 AS n FROM libsvm_entries)"""
_R = "round({}, 6) + 0.0 AS v"
_R9 = "round({}, 9) + 0.0 AS v"


def _m(select: str) -> str:
    return f"WITH {_M} {select}"


def _each(value: str) -> str:
    return _m(f"SELECT i, j, {_R.format(value)} FROM m")


_SQL_STATS = {"sum": "sum(v)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "median": "median(v)", "norm": "sqrt(sum(v * v))"}


def _sparse(stat: str, axis: int) -> str:
    key, size = ("j", "(SELECT n FROM n)") if axis == 0 else ("i", "780")
    value = {"sum": "sum(v)", "mean": f"sum(v) / {size}", "min": f"CASE WHEN count(*) < {size} THEN least(min(v), 0) ELSE min(v) END", "max": f"CASE WHEN count(*) < {size} THEN greatest(max(v), 0) ELSE max(v) END"}[stat]
    place = "0::BIGINT AS i, j" if axis == 0 else "i, 0::BIGINT AS j"
    return f"WITH {_S} SELECT {place}, {_R9.format('x')} FROM (SELECT {key}, {value} AS x FROM s GROUP BY {key}) WHERE x <> 0"


_HASH = "((xor(h, h >> 15)) * 2246822519) % 2147483648"
_HASHED = f"hashed AS (SELECT vec_id, embedding[1]::DOUBLE AS v, label, {_HASH} AS h FROM (SELECT *, ((vec_id % 2147483648) * 2654435761 + 7 * 40503) % 2147483648 AS h FROM embeddings))"
ORACLES = {
    **{f"arr_{s}_axis0": _m(f"SELECT 0::BIGINT AS i, j, {_R.format(x)} FROM m GROUP BY j") for s, x in _SQL_STATS.items()},
    **{f"arr_{s}_axis1": _m(f"SELECT i, 0::BIGINT AS j, {_R.format(x)} FROM m GROUP BY i") for s, x in _SQL_STATS.items()},
    **{f"sparse_{s}_axis{axis}": _sparse(s, axis) for s in ("sum", "min", "max", "mean") for axis in (0, 1)},
    "arr_add_scalar": _each("v + 2.5"),
    "arr_sub_rowvec": _each("v - avg(v) OVER (PARTITION BY j)"),
    "arr_mul_scalar": _each("v * 3"),
    "arr_mul_rowvec": _each("v * max(v) OVER (PARTITION BY j)"),
    "arr_div_scalar": _each("v / 4"),
    "arr_pow": _each("v * v"),
    "arr_sqrt": _each("abs(v)"),
    "arr_exp": _each("exp(v)"),
    "arr_log": _each("ln(v * v + 1)"),
    "arr_gammaln": _each("lgamma(v * v + 1)"),
    "arr_ne": _each("CASE WHEN v <> min(v) OVER (PARTITION BY j) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "arr_iadd": _each("v + v * 2"),
    "arr_slice_rows": _m(f"SELECT i - 10 AS i, j, {_R.format('v')} FROM m WHERE i >= 10 AND i < 30"),
    "arr_slice_cols": _m(f"SELECT i, j - 5 AS j, {_R.format('v')} FROM m WHERE j >= 5 AND j < 9"),
    "arr_slice_both": _m(f"SELECT i - 10 AS i, j - 5 AS j, {_R.format('v')} FROM m WHERE i >= 10 AND i < 30 AND j >= 5 AND j < 9"),
    "arr_list_rows": _m(f"SELECT k::BIGINT AS i, j, {_R.format('v')} FROM m JOIN (VALUES (7, 0), (3, 1), (19, 2)) t(r, k) ON i = r"),
    "arr_list_cols": _m(f"SELECT i, k::BIGINT AS j, {_R.format('v')} FROM m JOIN (VALUES (9, 0), (0, 1), (4, 2)) t(c, k) ON j = c"),
    "arr_get_item": _m(f"SELECT 0::BIGINT AS i, 0::BIGINT AS j, {_R.format('v')} FROM m WHERE i = 4 AND j = 6"),
    "arr_set_item": _each("CASE WHEN i = 2 AND j = 3 THEN 7.5::DOUBLE ELSE v END"),
    "arr_set_column": _each("CASE WHEN j = 1 THEN max(CASE WHEN j = 0 THEN v END) OVER (PARTITION BY i) ELSE v END"),
    "arr_delete": _m(f"SELECT i - CASE WHEN i > 5 THEN 2 ELSE 1 END AS i, j - CASE WHEN j > 1 THEN 1 ELSE 0 END AS j, {_R.format('v')} FROM m WHERE i NOT IN (0, 5) AND j NOT IN (1, 63)"),
    "arr_transpose": _m(f"SELECT j AS i, i AS j, {_R.format('v')} FROM m"),
    "arr_concat_rows": _m(f"SELECT i + k * (SELECT count(*) FROM embeddings) AS i, j, {_R.format('v')} FROM m, (VALUES (0), (1)) t(k)"),
    "arr_concat_columns": _m(f"SELECT i, j + k * 64 AS j, {_R.format('v')} FROM m, (VALUES (0), (1)) t(k)"),
    "arr_rechunk": _each("v"),
    "arr_pad": f"""WITH {_M}, size AS (SELECT count(*) AS n FROM embeddings)
        SELECT r.i, c.j, coalesce(round(v, 6) + 0.0, -1.0::DOUBLE) AS v
        FROM (SELECT unnest(range((SELECT n FROM size) + 3)) AS i) r CROSS JOIN (SELECT unnest(range(67)) AS j) c LEFT JOIN m ON m.i + 1 = r.i AND m.j = c.j""",
    "arr_zeros_full": "SELECT i, j, CASE WHEN i < 3 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS v FROM range(5) a(i), range(4) b(j)",
    "arr_eye": "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(4) a(i), range(6) b(j)",
    "arr_identity": "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(5) a(i), range(5) b(j)",
    "arr_apply_std_axis0": _m(f"SELECT 0::BIGINT AS i, j, {_R.format('stddev_pop(v)')} FROM m GROUP BY j"),
    "arr_apply_std_axis1": _m(f"SELECT i, 0::BIGINT AS j, {_R.format('stddev_pop(v)')} FROM m GROUP BY i"),
    "arr_apply_elementwise": _each("v * v"),
    "matadd": _each("v + v * 2"),
    "matsubtract": _each("v - v * 2"),
    "matmul_ab": _m(f"SELECT i, k AS j, {_R.format('sum(v * CASE WHEN j = k THEN 2 ELSE 1 END)')} FROM m, range(8) t(k) GROUP BY i, k"),
    "matmul_tiles": _m(f"SELECT i, k AS j, {_R.format('sum(v * CASE WHEN j = k THEN 2 ELSE 1 END)')} FROM m, range(8) t(k) GROUP BY i, k"),
    "matmul_gram": _m(f"SELECT a.j AS i, b.j AS j, {_R.format('sum(a.v * b.v)')} FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j"),
    "matmul_a_bt": _m(f"SELECT a.i AS i, b.i AS j, {_R.format('sum(a.v * b.v)')} FROM m a JOIN m b ON a.j = b.j GROUP BY a.i, b.i"),
    "kron": """WITH a AS (SELECT n_nationkey::BIGINT AS i, 0 AS j, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 1, n_regionkey FROM nation),
        b AS (SELECT r_regionkey::BIGINT AS i, 0 AS j, r_regionkey AS v FROM region UNION ALL SELECT r_regionkey, 1, r_regionkey + 2 FROM region)
        SELECT a.i * (SELECT count(*) FROM region) + b.i AS i, (a.j * 2 + b.j)::BIGINT AS j, (a.v * b.v)::DOUBLE AS v FROM a, b""",
    "sparse_transpose": f"WITH {_S} SELECT j AS i, i AS j, {_R9.format('v')} FROM s",
    "sparse_scale": f"WITH {_S} SELECT i, j, {_R9.format('v * 3')} FROM s",
    "sparse_gram": f"WITH {_S} SELECT a.i AS i, b.i AS j, {_R9.format('sum(a.v * b.v)')} FROM s a JOIN s b ON a.j = b.j GROUP BY a.i, b.i",
    "trajectory_mean": f"""WITH f AS (SELECT generate_subscripts(features, 1)::BIGINT - 1 AS j, unnest(features) AS v FROM traj_frames WHERE len(features) = 36)
        SELECT 0::BIGINT AS i, j, {_R.format('avg(v)')} FROM f GROUP BY j""",
    "terasort_values": _m(f"SELECT r // 64 AS i, r % 64 AS j, {_R.format('v')} FROM (SELECT v, row_number() OVER (ORDER BY v, i, j) - 1 AS r FROM m)"),
    "terasort_columns": _m(f"""SELECT row_number() OVER (PARTITION BY j ORDER BY v, i) - 1 AS i, CASE j WHEN 0 THEN 0 WHEN 5 THEN 1 ELSE 2 END::BIGINT AS j, {_R.format('v')}
        FROM m WHERE j IN (0, 5, 9)"""),
    "shuffle_hash": f"WITH {_HASHED} SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS row_idx, round(v, 6) AS v, label::DOUBLE AS label FROM hashed",
    "train_test_split_hash": f"""WITH {_HASHED},
        placed AS (SELECT *, vec_id // 100 AS b, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY h, vec_id) - 1 AS p, count(*) OVER (PARTITION BY vec_id // 100) AS k FROM hashed),
        parted AS (SELECT *, CASE WHEN p < floor(k * 0.75 + 1e-9) THEN 'train' WHEN p < floor(k * 0.75 + 1e-9) + floor(k * 0.25 + 1e-9) THEN 'test' END AS part FROM placed)
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY b, h, vec_id) - 1 AS row_idx, round(v, 6) AS v FROM parted WHERE part IS NOT NULL""",
    "kfold": """WITH size AS (SELECT count(*) AS n FROM embeddings),
        folds AS (SELECT k, k * (n // 4) + least(k, n % 4) AS a, (k + 1) * (n // 4) + least(k + 1, n % 4) AS b FROM range(4) t(k), size)
        SELECT k::INT AS fold, CASE WHEN vec_id >= a AND vec_id < b THEN 'test' ELSE 'train' END AS part,
               CASE WHEN vec_id < a THEN vec_id WHEN vec_id < b THEN vec_id - a ELSE vec_id - (b - a) END AS row_idx, round(embedding[1]::DOUBLE, 6) AS v
        FROM embeddings, folds""",
}
