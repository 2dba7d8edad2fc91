"""Scalers of array columns; fitted statistics are small row vectors that go into the plan as literals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray, _lit_array, array
from blockframe.estimator import Estimator
from blockframe.functions.reductions import by_column


def _divided(x: Column, y: Column) -> Column:
    """x / y as NumPy has it: infinities and NaN instead of errors."""
    inf = F.lit(math.inf)
    zero = F.when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(math.nan))
    return F.when(y != 0, x / F.when(y != 0, y)).otherwise(zero)


def _zip(x: DsArray, f, *vectors) -> DsArray:
    """``f(value, *column statistics)`` of every value."""
    rows = F.transform("features", lambda v, j: f(v, *[F.get(_lit_array(s), j) for s in vectors]))
    return x._new(x.df.select("row_idx", rows.alias("features")), sparse=False)


def _vector(a: DsArray) -> list[float]:
    return np.asarray(a.collect(squeeze=False), float).reshape(-1).tolist()


class MinMaxScaler(Estimator):
    """Scale columns to a range. A constant column becomes the lower bound."""

    def __init__(self, feature_range: tuple[float, float] = (0, 1)):
        self.feature_range = tuple(feature_range)
        self.data_min_ = self.data_max_ = None

    def fit(self, x: DsArray) -> MinMaxScaler:
        dense = x.to_dense()
        self.data_min_, self.data_max_ = array(dense.min(0).collect(squeeze=False)), array(dense.max(0).collect(squeeze=False))
        return self

    def fit_transform(self, x: DsArray) -> DsArray:
        return self.fit(x).transform(x)

    def transform(self, x: DsArray) -> DsArray:
        self._check("data_min_", "data_max_")
        a, b = (float(v) for v in self.feature_range)
        low, high = np.array(_vector(self.data_min_)), np.array(_vector(self.data_max_))
        span = high - low
        return _zip(x.to_dense(), lambda v, lo, s: F.when(s == 0, F.lit(0.0)).otherwise((v - lo) / F.when(s != 0, s)) * F.lit(b - a) + F.lit(a), low, span)

    def inverse_transform(self, x: DsArray) -> DsArray:
        self._check("data_min_", "data_max_")
        a, b = (float(v) for v in self.feature_range)
        low, high = np.array(_vector(self.data_min_)), np.array(_vector(self.data_max_))
        unit = (lambda v: (v - F.lit(a)) / F.lit(b - a)) if b != a else (lambda v: F.lit(1.0))
        return _zip(x.to_dense(), lambda v, lo, s: unit(v) * s + lo, low, high - low)


class StandardScaler(Estimator):
    """Centre columns and divide by the population standard deviation; a constant column gives NaN or infinities, as in NumPy."""

    def __init__(self):
        self.mean_ = self.var_ = None

    def fit(self, x: DsArray) -> StandardScaler:
        """One pass: mean and population variance of all columns."""
        dense = x.to_dense()
        n, m = dense.shape
        if m <= 128:
            v = [F.get("features", F.lit(j)) for j in range(m)]
            row = dense.df.agg(F.array(*[F.avg(c) for c in v]).alias("mean"), F.array(*[F.var_pop(c) for c in v]).alias("var")).first()
            self.mean_, self.var_ = array(np.array([row["mean"]], float)), array(np.array([row["var"]], float))
        else:
            self.mean_ = array(by_column(dense, "mean").collect(squeeze=False))
            self.var_ = array(by_column(dense, "var").collect(squeeze=False))
        return self

    def fit_transform(self, x: DsArray) -> DsArray:
        return self.fit(x).transform(x)

    def transform(self, x: DsArray) -> DsArray:
        self._check("mean_", "var_")
        std = np.sqrt(_vector(self.var_))
        return _zip(x.to_dense(), lambda v, mu, s: _divided(v - mu, s), _vector(self.mean_), std)

    def inverse_transform(self, x: DsArray) -> DsArray:
        self._check("mean_", "var_")
        std = np.sqrt(_vector(self.var_))
        return _zip(x.to_dense(), lambda v, mu, s: v * s + mu, _vector(self.mean_), std)
