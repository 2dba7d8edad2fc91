"""Alternating least squares with weighted regularisation.

Ratings stay entries (i, j, v). They are laid out twice, by user and by item, once before the first pass: each row in the task of its key, sorted,
and a key with very many ratings split over the tasks of its shards (:mod:`blockframe.plans.balance`). A half pass then reads one layout
without a shuffle: the other side's factors are broadcast while they have at most ``BROADCAST_VALUES`` values, and joined beyond. Normal equations
of all keys of a slice are summed at once; those of a split key are summed over its shards, so no key falls to one task. They also hold the
squared errors of their ratings, so the RMSE of the ratings themselves takes no pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray, session
from blockframe.estimator import Estimator
from blockframe.linalg import BROADCAST_VALUES
from blockframe.operators.skew import fragment_replicate_join
from blockframe.plans.balance import Plan, make_plan, route
from blockframe.plans.index import DRIVER_VALUES
from blockframe.plans.runtime import durable

STATE = "id bigint, f array<double>, n bigint, e double, s array<double>"
#: Ratings of a packed row, values of the sums that a task holds at once, and columns up to which sums go column by column.
PACK, SLICE_VALUES, NARROW = 16_384, 4_000_000, 24


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1]), pa.array(x.ravel()))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ratings in the order they come, up to ``PACK`` of them as lists in one row."""
    for b in batches:
        for at in range(0, len(b), PACK):
            part = b.slice(at, PACK)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in part.columns], names=b.schema.names)


class _Layout:
    """Ratings (own, id, v) in the order of one side, with the plan of its keys and that of the join with the other side's.

    Where the other side's factors, of ``values`` values, are broadcast, rows are packed.
    """

    def __init__(self, ratings: DataFrame, own: str, other: str, values: int):
        rows = ratings.select(F.col(own).alias("own"), F.col(other).alias("id"), F.col("v").cast("double").alias("v"))
        self.plan: Plan = make_plan(rows, ["own"])
        self.join_plan: Plan | None = None
        self.split = np.array(sorted(k[0] for k in self.plan.heavy), np.int64)
        self.packed = values <= BROADCAST_VALUES
        rows = route(rows, ["own"], self.plan, ["id"]).drop("__task").sortWithinPartitions("own")
        self.rows = durable(rows.mapInArrow(_pack, "own array<bigint>, id array<bigint>, v array<double>") if self.packed else rows)

    def with_factors(self, factors: pa.Table | DataFrame) -> tuple[DataFrame, object]:
        """Rows to stream, and the broadcast factors (ids, matrix), or rows with their factors and None."""
        if self.packed:
            f = factors if isinstance(factors, pa.Table) else factors.select("id", "f").orderBy("id").toArrow()
            ids = f["id"].to_numpy()
            return self.rows, session().sparkContext.broadcast((ids, _matrix(f["f"], max(1, len(f["f"].combine_chunks().flatten()) // max(1, len(ids))))))
        self.join_plan = self.join_plan or make_plan(self.rows, ["id"])
        joined = fragment_replicate_join(self.rows, _frame(factors), ["id"], plan=self.join_plan, spread=["own"])
        return route(joined, ["own"], self.plan, ["id"]).drop("__task").sortWithinPartitions("own"), None


def _frame(factors: pa.Table | DataFrame) -> DataFrame:
    """(id, f)."""
    return session().createDataFrame(factors.select(["id", "f"])) if isinstance(factors, pa.Table) else factors.select("id", "f")


def _end(shared) -> None:
    """Drops the factors of a half pass, of which there are many, from the disks of driver and executors."""
    if shared:
        shared.destroy()


def _gram(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For every run of rows, from one of ``begins`` to the next: the sum of x x^T."""
    d, ends = x.shape[1], [*begins[1:], len(x)]
    out = np.empty((len(begins), d, d))
    if d <= NARROW:
        t = np.ascontiguousarray(x.T)
        for p in range(d):
            for q in range(p, d):
                out[:, p, q] = out[:, q, p] = np.add.reduceat(t[p] * t[q], begins)
    else:
        for k, (s, e) in enumerate(zip(begins, ends, strict=True)):
            out[k] = x[s:e].T @ x[s:e]
    return out


def _solved(ids: np.ndarray, s: np.ndarray, n: np.ndarray, lam: float) -> pa.RecordBatch:
    """Factors of keys and the squared errors of their ratings, from the sums ``s`` of h h^T over their ratings, h being the factors and the value."""
    d = s.shape[1] - 1
    a, b = s[:, :d, :d], s[:, :d, d]
    f = np.linalg.solve(a + lam * n[:, None, None] * np.eye(d), b[..., None])[..., 0]
    e = s[:, d, d] - 2 * (f * b).sum(axis=1) + (f * (a @ f[..., None])[..., 0]).sum(axis=1)
    return pa.record_batch([pa.array(ids), _lists(f), pa.array(n), pa.array(np.maximum(e, 0.0)), pa.nulls(len(ids), pa.list_(pa.float64()))], names=["id", "f", "n", "e", "s"])


def _merged(parts: Iterator[pa.RecordBatch], d: int, lam: float) -> Iterator[pa.RecordBatch]:
    """Factors of split keys from the sums of their shards, which come in the order of the keys."""
    now, total, n = None, None, 0
    for b in parts:
        for i, k, s in zip(b["id"].to_numpy(), b["n"].to_numpy(), _matrix(b["s"], (d + 1) ** 2), strict=True):
            if i != now:
                if now is not None:
                    yield _solved(np.array([now]), total.reshape(1, d + 1, d + 1), np.array([n]), lam)
                now, total, n = i, np.zeros((d + 1) ** 2), 0
            total = total + s
            n += k
    if now is not None:
        yield _solved(np.array([now]), total.reshape(1, d + 1, d + 1), np.array([n]), lam)


class ALS(Estimator):
    """``lambda_`` is multiplied by a row's number of ratings. ``convergence_threshold`` is ``tol`` on the change of the RMSE."""

    transient = ("_users", "_items")

    def __init__(self, random_state: int | None = None, n_f: int = 100, lambda_: float = 0.065, tol: float = 1e-4, max_iter: int = 100, arity: int = 5, check_convergence: bool = True, verbose: bool = False):
        self.random_state, self.n_f, self.lambda_, self.tol, self.max_iter = random_state, n_f, lambda_, tol, max_iter
        self.arity, self.check_convergence, self.verbose = arity, check_convergence, verbose
        self.users = self.items = self.rmse_ = self.n_iter_ = self.converged = None
        self._users = self._items = None

    def _solve(self, layout: _Layout, factors: pa.Table | DataFrame, size: int) -> pa.Table | DataFrame:
        """(id, f, n, e) of the layout's side, of ``size`` values, given the other's factors: factors, ratings and their squared errors.

        What is small enough for the driver goes by way of it, sorted; the rest stays distributed.
        """
        d, lam, split = self.n_f, float(self.lambda_), layout.split
        rows, shared = layout.with_factors(factors)
        step = max(1, SLICE_VALUES // (d + 1) ** 2)

        def close(ids: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            parted = np.isin(ids, split)
            if not parted.all():
                yield _solved(ids[~parted], s[~parted], n[~parted], lam)
            if k := int(parted.sum()):
                columns = [pa.array(ids[parted]), pa.nulls(k, pa.list_(pa.float64())), pa.array(n[parted]), pa.nulls(k, pa.float64()), _lists(s[parted].reshape(k, -1))]
                yield pa.record_batch(columns, names=["id", "f", "n", "e", "s"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None  # the sums of the key at hand, of which more ratings may follow
            for batch in batches:
                own, v = ((batch[c].flatten() if shared else batch[c]).to_numpy() for c in ("own", "v"))
                if shared:
                    ids, matrix = shared.value
                    place = np.searchsorted(ids, batch["id"].flatten().to_numpy())
                else:
                    joined = _matrix(batch["f"], d)
                for at in range(0, len(own), step):
                    here = slice(at, at + step)
                    o = own[here]
                    begins = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                    s = _gram(np.column_stack([matrix[place[here]] if shared else joined[here], v[here]]), begins)
                    k, n = o[begins], np.diff(np.r_[begins, len(o)])
                    if last is not None and last[0][0] == k[0]:
                        s[0] += last[1][0]
                        n[0] += last[2][0]
                    elif last is not None:
                        k, s, n = (np.concatenate(x) for x in zip(last, (k, s, n), strict=True))
                    last = k[-1:].copy(), s[-1:].copy(), n[-1:].copy()
                    if len(k) > 1:
                        yield from close(k[:-1], s[:-1], n[:-1])
            if last is not None:
                yield from close(*last)

        out = rows.mapInArrow(run, STATE)
        states = sum(map(len, layout.plan.heavy.values()))
        if size + states * (d + 1) ** 2 <= DRIVER_VALUES:
            found = out.toArrow()
            _end(shared)
            parts = found.filter(found["f"].is_null()).sort_by("id").combine_chunks()
            whole = [found.filter(found["f"].is_valid()), *(pa.Table.from_batches([x]) for x in _merged(parts.to_batches(), d, lam))]
            return pa.concat_tables([x.select(["id", "f", "n", "e"]) for x in whole], promote_options="permissive").sort_by("id").combine_chunks()
        out = durable(out)
        _end(shared)
        whole = out.filter("f IS NOT NULL").select("id", "f", "n", "e")
        if not len(split):
            return whole
        parts = out.filter("f IS NULL").repartition("id").sortWithinPartitions("id").mapInArrow(lambda p: _merged(p, d, lam), STATE)
        return whole.unionByName(durable(parts.select("id", "f", "n", "e")))

    def fit(self, x: DsArray, test: DsArray | None = None) -> ALS:
        """Factorise the stored values of ``x`` (users x items); the RMSE is that of ``test``, or of ``x``."""
        if not x.sparse:
            raise ValueError("a sparse array is needed: absent places are missing ratings")
        d, seed = self.n_f, 0 if self.random_state is None else int(self.random_state)
        ratings = durable(x.df.select("i", "j", "v").filter("v <> 0"))

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = np.array([np.random.Generator(np.random.Philox(key=[seed, i])).random(d) for i in b["id"].to_pylist()]).reshape(-1, d)
                f[:, 0] = b["mean"].to_numpy()
                yield pa.record_batch([b["id"], _lists(f)], names=["id", "f"])

        means = ratings.groupBy(F.col("j").cast("bigint").alias("id")).agg(F.avg("v").cast("double").alias("mean"))
        items = durable(means.mapInArrow(start, "id bigint, f array<double>"))
        n_users, n_items, last = ratings.select("i").distinct().count(), items.count(), None  # of those with ratings
        by_user, by_item = _Layout(ratings, "i", "j", n_items * d), _Layout(ratings, "j", "i", n_users * d)
        self.converged = False
        for self.n_iter_ in range(1, self.max_iter + 1):
            users = self._solve(by_user, items, n_users * d)
            items = self._solve(by_item, users, n_items * d)
            if self.check_convergence or self.n_iter_ == self.max_iter:
                self.rmse_ = self._own_rmse(items) if test is None else self._rmse(test.to_sparse().df.select("i", "j", "v"), _frame(users), _frame(items), n_users * d, n_items * d)
                if self.check_convergence and last is not None and abs(last - self.rmse_) < self.tol:
                    self.converged = True
                    break
                last = self.rmse_
        self._users, self._items, self._shape = _frame(users), _frame(items), x.shape
        return self

    @staticmethod
    def _own_rmse(side: pa.Table | DataFrame) -> float:
        """Of the ratings that the factors of ``side`` were solved from."""
        if isinstance(side, pa.Table):
            return float(np.sqrt(side["e"].to_numpy().sum() / max(1, side["n"].to_numpy().sum())))
        return float(side.agg(F.sqrt(F.sum("e") / F.sum("n"))).first()[0] or 0.0)

    @staticmethod
    def _rmse(ratings: DataFrame, users: DataFrame, items: DataFrame, *values: int) -> float:
        u, i = users.select(F.col("id").alias("i"), F.col("f").alias("u")), items.select(F.col("id").alias("j"), "f")
        for side, key, size in zip((u, i), ("i", "j"), values, strict=True):
            ratings = ratings.join(F.broadcast(side), key) if size <= BROADCAST_VALUES else fragment_replicate_join(ratings, side, [key], spread=["i", "j"])
        dot = F.aggregate(F.zip_with("u", "f", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return float(ratings.agg(F.sqrt(F.avg((F.col("v") - dot) ** 2))).first()[0] or 0.0)

    def predict_user(self, user_id: int) -> np.ndarray:
        """Predicted ratings of all items for a user; NaN for items without ratings."""
        self._check("_users")
        if not 0 <= user_id < self._shape[0]:
            raise IndexError(f"there are {self._shape[0]} users")
        row = self._users.filter(F.col("id") == int(user_id)).first()
        out = np.full(self._shape[1], np.nan)
        if row is not None:
            f = F.lit([float(v) for v in row["f"]])
            dot = F.aggregate(F.zip_with("f", f, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            for r in self._items.select("id", dot.alias("p")).collect():
                out[r["id"]] = r["p"]
        return out

    def save_model(self, path: str, overwrite: bool = True, save_format: str = "json") -> None:
        """Factors go with the model as Parquet, in ``path`` + ``.users`` and ``.items``."""
        self._check("_users")
        super().save_model(path, overwrite, save_format)
        self._users.write.mode("overwrite").parquet(f"{path}.users")
        self._items.write.mode("overwrite").parquet(f"{path}.items")

    @classmethod
    def load_model(cls, path: str, load_format: str = "json"):
        out = super().load_model(path, load_format)
        out._users, out._items = (session().read.parquet(f"{path}.{n}") for n in ("users", "items"))
        return out
