"""Products and factorizations of distributed arrays.

A product broadcasts its right side only where that is at most ``BROADCAST_VALUES`` values; beyond, both sides are cut into
tiles that are joined on the inner tile number and summed. ``A.T @ A`` and ``A.T @ B`` of tall arrays are one pass that sums small
matrices. Tall factorizations are trees of local QR steps over partitions, so only small triangles reach the driver.

Signs are fixed: the diagonal of R is not negative; the entry of largest size of each right singular vector is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray, array, session
from blockframe.plans.index import ARITY, DRIVER_VALUES, reduce_partitions, stack, sum_states
from blockframe.plans.runtime import durable, reused

#: Values of a matrix that is broadcast, of a Gram matrix that is summed on the driver, and of a full Q that is built.
BROADCAST_VALUES, GRAM_VALUES, FULL_VALUES = 4_000_000, 4_000_000, 16_000_000
TILE = 512
#: Inner size up to which sparse products may go by dense strips, product of densities from which they do, and rows and columns of a strip.
INNER, DENSE, STRIP, BUCKETS = 100_000, 0.001, 512, 1024


def times(a: DsArray, b: np.ndarray) -> DsArray:
    """``a @ b`` for an in-memory ``b``, in one pass without a shuffle."""
    if b.size > BROADCAST_VALUES:
        raise ValueError(f"{b.shape} is too large to broadcast")
    m, shared = a.shape[1], session().sparkContext.broadcast(np.ascontiguousarray(b, float))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield pd.DataFrame({"row_idx": p["row_idx"], "features": list(stack(p["features"], m) @ shared.value)})

    return DsArray(a.to_dense().df.mapInPandas(run, "row_idx bigint, features array<double>"), (a.shape[0], b.shape[1]), False, a.block_size)


def cross(a: DsArray, b: DsArray | None = None) -> np.ndarray:
    """``a.T @ b`` (``a.T @ a`` without b) of tall arrays as an in-memory matrix."""
    m, k = a.shape[1], (b or a).shape[1]
    if m * k > GRAM_VALUES:
        raise ValueError(f"a {m} x {k} product is too large for the driver")
    df, alone = a.to_dense().df, b is None
    if not alone:
        df = df.join(b.to_dense().df.select("row_idx", F.col("features").alias("other")), "row_idx")

    def state(parts: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros((m, k))
        for p in parts:
            x = stack(p["features"], m)
            out += x.T @ (x if alone else stack(p["other"], k))
        return out

    return sum_states(df, state, m * k).reshape(m, k)


def _tiles(a: DsArray, row: str, col: str) -> DataFrame:
    """(row, col, tile, h, w): dense tiles of at most TILE x TILE values as flat arrays."""
    m = a.shape[1]
    starts = F.sequence(F.lit(0), F.lit((m - 1) // TILE))
    cut = a.to_dense().df.select(F.floor(F.col("row_idx") / TILE).alias(row), (F.col("row_idx") % TILE).alias("r"), F.explode(starts).alias(col), "features")
    cut = cut.select(row, F.col(col).cast("bigint").alias(col), "r", F.slice("features", F.col(col) * TILE + 1, F.lit(TILE)).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("r", "x"))), lambda e: e["x"])
    return cut.groupBy(row, col).agg(lines.alias("tile"))


def tile_matmul(a: DsArray, b: DsArray) -> DsArray:
    """``a @ b`` by tiles. Tiles of ``a`` are copied for every column of output tiles and those of ``b`` for every row of them, so the join is on
    the number of the output tile and the inner one and no task gets more than its share; products of an output tile are summed as they stream by.
    """
    (n, k), m = a.shape, b.shape[1]
    rows, inner, columns = (max(1, -(-x // TILE)) for x in (n, k, m))
    left = _tiles(a, "bi", "bk").withColumn("bj", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = _tiles(b, "bk", "bj").withColumnRenamed("tile", "other").withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    joined = left.join(right, ["bi", "bj", "bk"]).select("bi", "bj", "tile", "other")

    def matrix(x) -> np.ndarray:
        return np.array([np.asarray(v) for v in x], float)

    def product(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for bi, bj, x, y in zip(p["bi"], p["bj"], p["tile"], p["other"], strict=True):
                z = matrix(x) @ matrix(y)
                yield pd.DataFrame({"bi": [bi], "bj": [bj], "h": [len(z)], "z": [z.ravel()]})

    def unpack(bi: int, bj: int, z: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"row_idx": np.arange(len(z)) + bi * TILE, "bj": bj, "z": list(z)})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for p in parts:
            for bi, bj, h, z in zip(p["bi"], p["bj"], p["h"], p["z"], strict=True):
                z = np.asarray(z, float).reshape(h, -1)
                if (bi, bj) == now:
                    total = total + z
                    continue
                if now is not None:
                    yield unpack(*now, total)
                now, total = (bi, bj), z
        if now is not None:
            yield unpack(*now, total)

    partial = joined.mapInPandas(product, "bi bigint, bj bigint, h int, z array<double>")
    if inner > 1:
        partial = partial.repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    lines = partial.mapInPandas(add, "row_idx bigint, bj bigint, z array<double>")
    if columns == 1:
        return DsArray(lines.select("row_idx", F.col("z").alias("features")), (n, m))
    out = lines.groupBy("row_idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("bj", "z"))), lambda e: e["z"])).alias("features"))
    return DsArray(out, (n, m))


def _pages(left: DataFrame, right: DataFrame, n: int, k: int, m: int) -> list[tuple[int, int]] | None:
    """Ranges of columns of ``right`` with few enough entries to broadcast each, or None where entries are to be joined.

    The join makes a row of every product, of which dense entries have many for each value of the result. Strips need finite values, as those
    multiply with the zeros between entries too.
    """
    if not 0 < k <= INNER or not n or not m:
        return None

    def odd(v: str):
        return F.max((F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("int"))

    count, unfit = left.agg(F.count(F.lit(1)), odd("x")).first()
    width = -(-m // BUCKETS)
    found = right.groupBy(F.floor(F.col("j") / width).alias("b")).agg(F.count(F.lit(1)).alias("n"), odd("y").alias("odd")).orderBy("b").collect()
    entries, limit = sum(r["n"] for r in found), BROADCAST_VALUES // 2
    if unfit or any(r["odd"] or r["n"] > limit for r in found) or (count / n / k) * (entries / k / m) < DENSE:
        return None
    pages, held = [0], 0
    for r in found:
        if held + r["n"] > limit:
            pages.append(r["b"] * width)
            held = 0
        held += r["n"]
    return list(zip(pages, [*pages[1:], m], strict=True))


def _strips(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(i, j, v): the product of entries (i, k, x), sorted by rows that tasks hold whole, and entries (k, j, y), which are broadcast.

    Products are made by strips of ``STRIP`` rows and columns, and only places where entries meet come out: nothing is shuffled after them.
    """
    held = right.select("k", "j", "y").toArrow().sort_by("j")
    columns, begins = np.unique(held["j"].to_numpy(), return_index=True)
    shared = session().sparkContext.broadcast((held["k"].to_numpy().astype(np.int32), columns, np.r_[begins, len(held)], held["y"].to_numpy().astype(float)))

    def dense(row: np.ndarray, col: np.ndarray, v: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where they are stored."""
        x, there = np.zeros(shape), np.zeros(shape, np.float32)
        np.add.at(x, (row, col), v)
        there[row, col] = 1
        return x, there

    def product(i: np.ndarray, at: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        inner, cols, starts, y = shared.value
        ids, row = np.unique(i, return_inverse=True)
        used, place = np.unique(at, return_inverse=True)  # columns of the strip that have entries
        a, a_there = dense(row, place, x, (len(ids), len(used)))
        slot = np.full(k, -1, np.int32)
        slot[used] = np.arange(len(used), dtype=np.int32)
        for c in range(0, len(cols), STRIP):
            here = cols[c : c + STRIP]
            span = slice(starts[c], starts[c + len(here)])
            to, col = slot[inner[span]], np.repeat(np.arange(len(here)), np.diff(starts[c : c + len(here) + 1]))
            kept = to >= 0
            b, b_there = dense(col[kept], to[kept], y[span][kept], (len(here), len(used)))
            r, q = np.nonzero(a_there @ b_there.T)
            if len(r):
                yield pa.record_batch([pa.array(ids[r]), pa.array(here[q]), pa.array((a @ b.T)[r, q])], names=["i", "j", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            if not len(batch):
                continue
            parts.append([batch[c].to_numpy() for c in ("i", "k", "x")])
            rows += 1 + int(np.count_nonzero(np.diff(parts[-1][0])))
            if rows > STRIP:
                i, at, x = (np.concatenate(c) for c in zip(*parts, strict=True))
                begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                ends = begins[STRIP::STRIP] if len(begins) > STRIP else begins[-1:]  # the last row may go on
                for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True):
                    if e > s:
                        yield from product(i[s:e], at[s:e], x[s:e])
                parts, rows = [[c[ends[-1] :] for c in (i, at, x)]], len(begins) - int(np.searchsorted(begins, ends[-1]))
        if parts:
            yield from product(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    return left.select(F.col("i").cast("bigint"), F.col("k").cast("bigint"), F.col("x").cast("double")).mapInArrow(run, "i bigint, j bigint, v double")


def matmul(a: DsArray, b: DsArray, transpose_a: bool = False, transpose_b: bool = False) -> DsArray:
    """Matrix product of arrays or of their transposes."""
    n, k = a.shape[::-1] if transpose_a else a.shape
    k2, m = b.shape[::-1] if transpose_b else b.shape
    if k != k2:
        raise ValueError(f"inner sizes {k} and {k2} differ")
    if a.sparse and b.sparse:
        left = a.df.select(*[F.col(c).alias(d) for c, d in zip(("j", "i") if transpose_a else ("i", "j"), ("i", "k"), strict=True)], F.col("v").alias("x"))
        right = b.df.select(*[F.col(c).alias(d) for c, d in zip(("j", "i") if transpose_b else ("i", "j"), ("k", "j"), strict=True)], F.col("v").alias("y"))
        pages = _pages(left, right, n, k, m)
        if pages is None:
            out = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        else:
            rows, out = left.repartition("i").sortWithinPartitions("i"), None
            for begin, end in pages:
                part = _strips(rows, right.filter((F.col("j") >= begin) & (F.col("j") < end)), k)
                out = part if out is None else out.unionByName(part)
        return DsArray(out, (n, m), True)
    if transpose_a and not transpose_b and n * m <= GRAM_VALUES:
        return array(cross(a, None if a is b else b))
    if transpose_a:
        return matmul(a.T.to_dense(), b, transpose_b=transpose_b)
    if k * m <= BROADCAST_VALUES:
        right = np.asarray(b.collect(squeeze=False))
        return times(a, right.T if transpose_b else right)
    return tile_matmul(a, b.T.to_dense() if transpose_b else b)


def kron(a: DsArray, b: DsArray, block_size: tuple[int, int] | None = None) -> DsArray:
    """Kronecker product of dense arrays: every row of ``a`` against every row of ``b``, which is broadcast and so has a checked size."""
    if a.sparse or b.sparse:
        raise NotImplementedError("kron of sparse arrays")
    if b.shape[0] * b.shape[1] > BROADCAST_VALUES:
        raise ValueError(f"{b.shape} is too large to broadcast")
    (n, m), (h, w) = a.shape, b.shape
    shared = session().sparkContext.broadcast(b.collect(squeeze=False))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i, x in zip(p["row_idx"], p["features"], strict=True):
                rows = np.kron(np.asarray(x, float).reshape(1, m), shared.value)
                yield pd.DataFrame({"row_idx": np.arange(i * h, (i + 1) * h), "features": list(rows)})

    return DsArray(a.df.mapInPandas(run, "row_idx bigint, features array<double>"), (n * h, m * w), False, block_size)


def _signed_qr(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(x)
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * s, r * s[:, None]


def _r_factor(a: DsArray) -> np.ndarray:
    """R of a tall array: the R of each partition, of stacks of them over executors, and of the few stacks that are left."""
    m = a.shape[1]

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, m))
        for p in parts:
            r = np.linalg.qr(np.vstack([r, stack(p["features"], m)]), mode="r")
        if len(r):
            yield pd.DataFrame({"features": list(r)})

    arity = max(1, min(ARITY, DRIVER_VALUES // max(1, m * m)))
    rows = reduce_partitions(a.to_dense().df.select("features").mapInPandas(local, "features array<double>"), local, "features array<double>", arity).collect()
    r = np.linalg.qr(np.vstack([np.zeros((0, m)), *[np.array([x["features"]], float) for x in rows]]), mode="r")
    r = np.vstack([r, np.zeros((max(0, m - len(r)), m))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tsqr(a: DsArray, mode: str = "complete", indexes: list[int] | None = None):
    """QR of a tall array by a tree. Modes complete, complete_inverse, reduced, reduced_inverse, r_complete, r_reduced.

    ``indexes`` asks for some columns of Q only. The ``inverse`` modes differ only in how Q is formed elsewhere; results are the same.
    """
    if mode not in ("complete", "complete_inverse", "reduced", "reduced_inverse", "r_complete", "r_reduced"):
        raise ValueError(f"unknown mode {mode!r}")
    n, m = a.shape
    if n < m:
        raise ValueError("a tall array is needed")
    if indexes is not None and not mode.startswith(("complete", "reduced")):
        raise ValueError("indexes select columns of Q, which this mode does not build")
    r = _r_factor(a)
    if mode == "r_reduced":
        return array(r)
    if mode == "r_complete":
        return array(np.vstack([r, np.zeros((n - m, m))])) if n * m <= FULL_VALUES else _too_large(n, m)
    q = _q_factor(a, r)
    if mode.startswith("reduced"):
        return (q if indexes is None else q[:, list(indexes)]), array(r)
    full = _complete(q)
    return (full if indexes is None else full[:, list(indexes)]), array(np.vstack([r, np.zeros((n - m, m))]))


def _too_large(*shape: int):
    raise ValueError(f"a result of {shape} is too large")


def _q_factor(a: DsArray, r: np.ndarray) -> DsArray:
    """Q = A R^-1, orthogonalised once more; a rank-deficient array takes the pseudo-inverse and completes its null directions."""
    d = np.abs(np.diag(r))
    if d.size and d.min() > 1e-12 * max(d.max(), 1e-300):
        q = times(a, np.linalg.inv(r))
        r2 = _r_factor(q)
        return times(q, np.linalg.inv(r2))
    if a.shape[0] * a.shape[1] > FULL_VALUES:
        raise ValueError("a rank-deficient array of this size")
    return array(_signed_qr(np.asarray(a.collect(squeeze=False)))[0])


def _complete(q: DsArray) -> DsArray:
    """Q with the orthogonal complement of its columns, n x n."""
    n, m = q.shape
    if n * n > FULL_VALUES:
        _too_large(n, n)
    x = np.asarray(q.collect(squeeze=False))
    full = np.linalg.qr(np.hstack([x, np.eye(n)]))[0][:, :n]
    full[:, :m] = x
    rest = full[:, m:] - x @ (x.T @ full[:, m:])
    return array(np.hstack([x, np.linalg.qr(rest)[0]]) if n > m else x)


def qr(a: DsArray, mode: str = "full", overwrite_a: bool = False):
    """QR of an array with at least as many rows as columns: full, economic or r. ``overwrite_a`` is accepted; plans are immutable."""
    if mode not in ("full", "economic", "r"):
        raise ValueError(f"unknown mode {mode!r}")
    if a.shape[0] < a.shape[1]:
        raise ValueError("more columns than rows")
    return tsqr(a, {"full": "complete", "economic": "reduced", "r": "r_reduced"}[mode])


def _fix_signs(v: np.ndarray) -> np.ndarray:
    """+-1 per column so that its largest entry is positive."""
    at = np.abs(v).argmax(axis=0)
    return np.where(v[at, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def svd(a: DsArray, compute_uv: bool = True, sort: bool = True, copy: bool = True, eps: float = 1e-9):
    """Thin singular value decomposition (U, S as 1 x n, V) of a tall array, from the R of its QR."""
    n, m = a.shape
    if n < m:
        raise ValueError("more columns than rows")
    r = _r_factor(a)
    u, s, vt = np.linalg.svd(r)
    if not sort:
        order = np.argsort(np.abs(vt).argmax(axis=1), kind="stable")
        u, s, vt = u[:, order], s[order], vt[order]
    if not compute_uv:
        return array(s.reshape(1, -1))
    sign = _fix_signs(vt.T)
    return times(_q_factor(a, r), u * sign), array(s.reshape(1, -1)), array(vt.T * sign)


def _tail(s: np.ndarray, smallest: float, n: int, nsv: int) -> float:
    """Share of the spectrum that ``nsv`` values leave out, the rest bounded by the smallest of them."""
    rest = (n - nsv) * smallest**2
    total = rest + float((s**2).sum())
    return float(np.sqrt(rest / total)) if total > 0 else 0.0


def _check_growth(nsv: int, k: int, b: int, n: int) -> None:
    if nsv > n:
        raise ValueError("more singular values than columns")
    if k < nsv:
        raise ValueError("k must be at least the number of singular values")
    if k % b:
        raise ValueError("k must be a multiple of the block size")


def random_svd(a: DsArray, iters: int = 2, epsilon: float = 1e-3, tol: float = 1e-3, nsv: int | None = None, k: int | None = None, block: int = 4, random_state: int = 0):
    """Randomized block subspace iteration: (U, S as 1 x nsv, V), grown by ``block`` until the tail is at most ``epsilon``."""
    n, m = a.shape
    nsv = nsv or min(4 * block, m)  # the tail test below adds blocks until the rest of the spectrum is small
    k = k or -(-nsv // block) * block
    _check_growth(nsv, k, block, m)
    rng = np.random.default_rng(random_state)
    with reused(a.to_dense().df) as rows:
        return _random_svd(a._new(rows, sparse=False), iters, epsilon, tol, nsv, k, block, rng)


def _random_svd(kept: DsArray, iters: int, epsilon: float, tol: float, nsv: int, k: int, block: int, rng: np.random.Generator):
    n, m = kept.shape
    while True:
        width = min(k, m)
        q = np.linalg.qr(rng.standard_normal((m, width)))[0]
        for _ in range(max(1, iters)):
            y = times(kept, q)
            y = _q_factor(y, _r_factor(y)) if n >= width else y
            q, old = np.linalg.qr(cross(kept, y))[0], q
            if np.linalg.norm(q - old @ (old.T @ q)) <= tol:
                break
        y = times(kept, q)
        r = _r_factor(y)
        u, s, wt = np.linalg.svd(r)
        if _tail(s, s[min(nsv, len(s)) - 1], min(n, m), nsv) <= epsilon or width >= m:
            break
        k, nsv = k + block, min(nsv + block, m)
    v = q @ wt.T
    sign = _fix_signs(v)
    left = times(_q_factor(y._new(durable(y.df)), r), u * sign)
    return left[:, :nsv], array(s[:nsv].reshape(1, -1)), array((v * sign)[:, :nsv])


def lanczos_svd(a: DsArray, k: int, bs: int, rank: int, num_sv: int, tolerance: float = 1e-8, epsilon: float = 1e-3, max_num_iterations: int = 100, random_state: int = 0):
    """Block Golub-Kahan-Lanczos with restarts: (U, S as 1 x num_sv, V). The small basis lives on the driver, products are distributed.

    The basis has at most ``k`` columns; ``rank`` of them survive a restart. Grows k, rank and num_sv by ``bs`` until the tail is at most epsilon.
    """
    n, m = a.shape
    if num_sv > m:
        raise ValueError("more singular values than columns")
    if rank < num_sv:
        raise ValueError("rank must be at least the number of singular values")
    if k <= rank:
        raise ValueError("k must exceed rank")
    if k % bs or rank % bs:
        raise ValueError("k and rank must be multiples of the block size")
    with reused(a.to_dense().df) as rows:
        s, v = _lanczos(a._new(rows, sparse=False), k, bs, rank, num_sv, tolerance, epsilon, max_num_iterations, np.random.default_rng(random_state))
    v = v * _fix_signs(v)
    return times(a, v / np.maximum(s, 1e-300)), array(s.reshape(1, -1)), array(v)


def _lanczos(kept: DsArray, k: int, bs: int, rank: int, num_sv: int, tolerance: float, epsilon: float, max_num_iterations: int, rng: np.random.Generator):
    """Singular values and right vectors."""
    n, m = kept.shape
    basis = np.linalg.qr(rng.standard_normal((m, min(bs, m))))[0]
    while True:
        s = v = None
        for _ in range(max_num_iterations):
            block = basis[:, -min(bs, basis.shape[1]) :]
            while basis.shape[1] < min(k, m):
                block = cross(kept, times(kept, block))
                block -= basis @ (basis.T @ block)
                block -= basis @ (basis.T @ block)
                block = np.linalg.qr(block)[0][:, : min(k, m) - basis.shape[1]]
                basis = np.hstack([basis, block])
            r = _r_factor(times(kept, basis))
            _, s, wt = np.linalg.svd(r)
            v = basis @ wt.T
            residual = cross(kept, times(kept, v[:, :num_sv])) - v[:, :num_sv] * s[:num_sv] ** 2
            if basis.shape[1] >= m or np.linalg.norm(residual, axis=0).max() <= tolerance * max(s[0] ** 2, 1e-300):
                break
            basis = np.linalg.qr(np.hstack([v[:, :rank], residual[:, : min(bs, residual.shape[1])]]))[0]
        if _tail(s[:num_sv], s[num_sv - 1], min(n, m), num_sv) <= epsilon or num_sv >= m:
            break
        k, rank, num_sv = k + bs, rank + bs, min(num_sv + bs, m)
        basis = v[:, : min(rank, v.shape[1])]
    return s[:num_sv], v[:, :num_sv]


__all__ = ["cross", "kron", "lanczos_svd", "matmul", "qr", "random_svd", "svd", "tile_matmul", "times", "tsqr"]
