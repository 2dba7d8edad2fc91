"""Elementwise functions of arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray, apply_elementwise


def exp(a: DsArray) -> DsArray:
    return a.to_dense()._map(F.exp)


def log(a: DsArray) -> DsArray:
    """Natural logarithm; -inf of 0 and NaN of negative values, as NumPy has it."""
    return a.to_dense()._map(lambda x: F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan)))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: math.inf if v <= 0 and v == math.floor(v) else math.lgamma(v), otypes=[float])(x)


def gammaln(a: DsArray) -> DsArray:
    """Logarithm of the absolute gamma function; Spark has no built-in, so it runs on Arrow batches."""
    return apply_elementwise(_lgamma, a)


def conj(z: Column) -> Column:
    """Complex conjugate of a struct<re, im> column."""
    return F.struct(z["re"].alias("re"), (-z["im"]).alias("im"))
