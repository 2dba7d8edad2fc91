import numpy as np
import pytest

from blockframe import dsarray as A
from blockframe import linalg as L


def got(a):
    return np.asarray(a.collect(squeeze=False))


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(17, 5))


def test_products(spark, x):
    a = A.array(x)
    np.testing.assert_allclose(got(a @ a.T), x @ x.T)
    np.testing.assert_allclose(got(L.matmul(a, a, transpose_b=True)), x @ x.T)
    np.testing.assert_allclose(got(L.matmul(a, a, transpose_a=True)), x.T @ x)
    np.testing.assert_allclose(got(L.matmul(a, a[:, 0:2], transpose_a=True)), x.T @ x[:, :2])
    np.testing.assert_allclose(got(L.tile_matmul(a, a.T)), x @ x.T)
    np.testing.assert_allclose(got(a.to_sparse() @ a.T.to_sparse()), x @ x.T)
    np.testing.assert_allclose(got(L.matmul(a.to_sparse(), a.to_sparse(), transpose_a=True)), x.T @ x)
    np.testing.assert_allclose(got(L.kron(a[:3], a[:2])), np.kron(x[:3], x[:2]))
    with pytest.raises(ValueError):
        L.matmul(a, a)
    with pytest.raises(NotImplementedError):
        L.kron(a.to_sparse(), a)


def test_tiles_over_several_blocks(spark, monkeypatch, x):
    monkeypatch.setattr(L, "TILE", 4)
    a = A.array(x)
    np.testing.assert_allclose(got(L.tile_matmul(a, a.T)), x @ x.T)


@pytest.mark.parametrize("shape", [(17, 5), (9, 7), (4, 4), (12, 1)])
def test_qr(spark, shape):
    x = np.random.default_rng(1).normal(size=shape)
    n, m = shape
    for mode in ("reduced", "reduced_inverse", "complete", "complete_inverse"):
        q, r = (got(v) for v in L.tsqr(A.array(x), mode))
        np.testing.assert_allclose(q @ r, x, atol=1e-10)
        np.testing.assert_allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-10)
        assert np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all()
    np.testing.assert_allclose(got(L.qr(A.array(x), "r")), r[:m], atol=1e-10)
    assert L.tsqr(A.array(x), "r_complete").shape == (n, m)
    assert L.tsqr(A.array(x), "reduced", indexes=[0])[0].shape == (n, 1)


def test_rank_deficient(spark):
    x = np.ones((8, 3))
    q, r = (got(v) for v in L.qr(A.array(x), "economic"))
    np.testing.assert_allclose(q @ r, x, atol=1e-10)


def test_errors(spark, x):
    for bad in (lambda: L.qr(A.array(x), "half"), lambda: L.qr(A.array(x.T)), lambda: L.svd(A.array(x.T)), lambda: L.tsqr(A.array(x), "r_reduced", indexes=[0])):
        with pytest.raises(ValueError):
            bad()
    a = A.array(x)
    for k, bs, rank, nsv in ((8, 4, 4, 6), (4, 4, 4, 4), (6, 4, 4, 4), (8, 3, 6, 4), (8, 4, 4, 5)):
        with pytest.raises(ValueError):
            L.lanczos_svd(a, k, bs, rank, nsv)
    for nsv, k in ((6, 8), (5, 4), (4, 5)):
        with pytest.raises(ValueError):
            L.random_svd(a, nsv=nsv, k=k, block=4)


def test_svd(spark, x):
    for v in (x, np.array([[1.0, 0, 0, 0], [0, 0, 0, 2], [0, 3, 0, 0], [2, 0, 0, 0]])):
        u, s, w = (got(m) for m in L.svd(A.array(v)))
        np.testing.assert_allclose(u * s @ w.T, v, atol=1e-10)
        np.testing.assert_allclose(s[0], np.linalg.svd(v)[1], atol=1e-10)
        np.testing.assert_allclose(np.linalg.norm(w, axis=0), 1)


def test_iterative_svd(spark):
    r = np.random.default_rng(0)
    m = np.linalg.qr(r.normal(size=(60, 20)))[0] * np.logspace(0, -6, 20) @ np.linalg.qr(r.normal(size=(20, 20)))[0]
    s = np.linalg.svd(m)[1]
    for u, v, w in (L.random_svd(A.array(m), iters=6, nsv=4, k=8, epsilon=1e-2), L.lanczos_svd(A.array(m), 8, 4, 4, 4, epsilon=1e-2)):
        k = v.shape[1]
        assert k >= 4
        np.testing.assert_allclose(got(v)[0], s[:k], atol=1e-5)  # convergence is relative to the largest value
        np.testing.assert_allclose(got(u) * got(v) @ got(w).T, m, atol=2e-2)
