import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockframe import dsarray as A
from blockframe.functions import elementwise
from blockframe.functions.elementwise import exp, gammaln, log

SHAPES = [(1, 1), (1, 6), (7, 1), (17, 5)]


@pytest.fixture(params=SHAPES, ids=str)
def pair(request, spark):
    x = np.random.default_rng(sum(request.param)).normal(size=request.param)
    return x, A.array(x)


def same(a, b):
    np.testing.assert_allclose(np.asarray(a.collect(squeeze=False)), b, rtol=1e-9, atol=1e-12)


def test_reductions(pair):
    x, a = pair
    for axis in (0, 1):
        for f in ("min", "max", "sum", "mean", "median"):
            same(getattr(a, f)(axis), getattr(np, f)(x, axis=axis, keepdims=True))
        same(a.norm(axis), np.linalg.norm(x, axis=axis, keepdims=True))
        same(A.apply_along_axis(np.std, axis, a), x.std(axis=axis, keepdims=True))


def test_elementwise(pair):
    x, a = pair
    same(a + 2, x + 2)
    same(2 + a, x + 2)
    same(a - a.mean(0), x - x.mean(0))
    same(a * a.max(0), x * x.max(0))
    same(a / 4, x / 4)
    same((a**2).sqrt(), abs(x))
    same(exp(a), np.exp(x))
    same(log(a**2), np.log(x**2))
    same(gammaln(a**2 + 1), np.vectorize(math.lgamma)(x**2 + 1))
    same(a != x[0], (x != x[0]).astype(float))
    same(A.matadd(a, a), 2 * x)
    same(A.matsubtract(a, a), 0 * x)


def test_division_by_zero_and_log_follow_numpy(spark):
    a = A.array(np.array([[1.0, -1.0, 0.0]]))
    got = (a / 0).collect()
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    got = log(a).collect()
    assert got[0] == 0 and math.isnan(got[1]) and got[2] == -math.inf


def test_indexing(spark):
    x = np.arange(40.0).reshape(8, 5)
    a = A.array(x)
    same(a[3], x[3:4])
    same(a[2, 3], x[2:3, 3:4])
    same(a[2:5, 1:3], x[2:5, 1:3])
    same(a[5:99], x[5:])
    same(a[[5, 2, 2]], x[[5, 2, 2]])
    same(a[:, [4, 0]], x[:, [4, 0]])
    same(a.T, x.T)
    assert a[3:3].shape == (0, 5)
    for bad in (8, (0, 5), (8, 0)):
        with pytest.raises(IndexError):
            a[bad]
    for bad in (slice(None, None, 2), slice(-2, None)):
        with pytest.raises(NotImplementedError):
            a[bad]
    with pytest.raises(NotImplementedError):
        a[:, 2]
    with pytest.raises(ValueError):
        a.transpose("sideways")


def test_assignment_delete_pad_and_concatenation(spark):
    x = np.arange(40.0).reshape(8, 5)
    a, y = A.array(x), x.copy()
    b = a.copy()
    b[2, 3] = y[2, 3] = 7
    b[4:8, 1] = y[4:8, 1] = np.arange(4)
    same(b, y)
    same(a, x)
    same(a.delete(i=[1, 5], j=[0]), np.delete(np.delete(x, [1, 5], 0), 0, 1))
    with pytest.raises(ValueError):
        a.delete()
    same(A.pad(a, ((1, 2), (0, 3)), 9.0), np.pad(x, ((1, 2), (0, 3)), constant_values=9.0))
    same(A.concat_rows(a, a), np.vstack([x, x]))
    same(A.concat_columns(a, a), np.hstack([x, x]))
    with pytest.raises(ValueError):
        A.concat_rows(a, a.T)
    c = A.DsArray(a.df, a.shape, False, (5, 2)).replace_block(1, 2, np.full((3, 1), -1.0))
    y = x.copy()
    y[5:, 4] = -1
    same(c, y)
    b = a.copy()
    b += a
    same(b, 2 * x)


def test_creation(spark):
    same(A.eye(3, 5), np.eye(3, 5))
    same(A.identity(3), np.eye(3))
    same(A.full((2, 3), 4.0), np.full((2, 3), 4.0))
    same(A.zeros((2, 3)), np.zeros((2, 3)))
    one, two = A.random_array((50, 3), random_state=1).collect(), A.random_array((50, 3), random_state=1).collect()
    assert (one == two).all() and (0 <= one).all() and (one < 1).all()
    for bad in (lambda: A.zeros((2, 2), (3, 1)), lambda: A.array(np.zeros((2, 2)), (3, 1)), lambda: A.array(np.zeros((2, 2, 2)))):
        with pytest.raises(ValueError):
            bad()
    same(A.load_blocks_rechunk([[np.ones((2, 2)), np.zeros((2, 1))]] * 2, (4, 3), (2, 2), (4, 1)), np.tile([1.0, 1, 0], (4, 1)))


def test_sparse(spark):
    x = np.random.default_rng(3).normal(size=(6, 4)) * (np.random.default_rng(4).random((6, 4)) < 0.4)
    s = A.array(x).to_sparse()
    same(s, x)
    same(s.to_dense(), x)
    same(s.T, x.T)
    same(s[1:4, 1:3], x[1:4, 1:3])
    same(s * 3, x * 3)
    same(A.matadd(s, s), 2 * x)
    same(A.concat_rows(s, s), np.vstack([x, x]))
    for axis in (0, 1):
        for f in ("min", "max", "sum", "mean"):
            same(getattr(s, f)(axis), getattr(np, f)(x, axis=axis, keepdims=True))
    for f in (s.median, s.norm):
        with pytest.raises(NotImplementedError):
            f(0)
    with pytest.raises(NotImplementedError):
        s.rechunk((1, 1))
    with pytest.raises(ValueError):
        s @ A.array(x).T


def test_entries_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 0, None), (1, 1, 0.0)], "i bigint, j bigint, v double")
    same(A.from_entries(df, (2, 2)), np.array([[0, 5.0], [0, 0]]))


def test_conjugate(spark):
    df = spark.createDataFrame([((1.0, 2.0),)], "z struct<re: double, im: double>").select(elementwise.conj(F.col("z")).alias("z"))
    assert tuple(df.first()["z"]) == (1.0, -2.0)


def test_blocks_are_filled(spark):
    x = np.arange(35.0).reshape(7, 5)
    a = A.DsArray(A.array(x).df, x.shape, False, (3, 2))
    assert A.bottom_right_shape(a) == (1, 1)
    whole = A.pad_last_blocks_with_zeros(a)
    assert whole.shape == (9, 6) and A.bottom_right_shape(whole) == (3, 2)
    same(A.remove_last_columns(A.remove_last_rows(whole, 2), 1), x)
