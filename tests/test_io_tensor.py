import numpy as np
import pytest

from blockframe import dsarray as A
from blockframe import tensor as T
from blockframe.sources.readers import load_hstack_npy_files, load_mdcrd_file, load_npy_file, load_npy_files, load_svmlight_file, load_txt_file
from blockframe.sources.writers import save_npy_file, save_txt


def got(a):
    return np.asarray(a.collect(squeeze=False))


def test_text(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(30, 4)).round(6)
    p = tmp_path / "x.csv"
    p.write_text("i,a,b,c,d\n" + "\n".join(f"{k}," + ",".join(map(str, r)) for k, r in enumerate(x)) + "\n")
    np.testing.assert_allclose(got(load_txt_file(str(p), discard_first_row=True, col_of_index=True)), x)
    p.write_text("3 4 5\n6  7 8\n")
    np.testing.assert_allclose(got(load_txt_file(str(p), delimiter=" ")), [[3, 4, 5], [6, 7, 8]])
    with pytest.raises(ValueError):
        load_txt_file(str(p), (3, 1), delimiter=" ")


def test_svmlight(spark, tmp_path):
    p = tmp_path / "x.svm"
    p.write_text("1 1:2.5 3:1 # note\n0 2:-1\n1\n")
    x, y = load_svmlight_file(str(p), None, 3)
    np.testing.assert_allclose(got(x), [[2.5, 0, 1], [0, -1, 0], [0, 0, 0]])
    np.testing.assert_allclose(got(y)[:, 0], [1, 0, 1])
    p.write_text("1 0:2.5 2:1\n")
    assert got(load_svmlight_file(str(p), None, 3, store_sparse=False)[0]).tolist() == [[2.5, 0, 1]]


def test_npy(spark, tmp_path):
    x = np.arange(24.0).reshape(6, 4)
    np.save(tmp_path / "x.npy", x)
    np.testing.assert_array_equal(got(load_npy_file(str(tmp_path / "x.npy"))), x)
    for bad in (np.asfortranarray(x), x.reshape(2, 3, 4)):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(ValueError):
            load_npy_file(str(tmp_path / "bad.npy"))
    grid = tmp_path / "grid"
    save_npy_file(A.DsArray(A.array(x).df, x.shape, False, (4, 3)), str(grid))
    assert sorted(f.name for f in grid.iterdir()) == ["0_0.npy", "0_1.npy", "1_0.npy", "1_1.npy"]
    np.testing.assert_array_equal(got(load_npy_files(str(grid), (6, 4))), x)
    with pytest.raises(ValueError):
        load_npy_files(str(grid))
    side = tmp_path / "side"
    side.mkdir()
    np.save(side / "a.npy", x[:, :1])
    np.save(side / "b.npy", x[:, 1:])
    np.testing.assert_array_equal(got(load_hstack_npy_files(str(side))), x)


def test_save_text(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    a = A.DsArray(A.array(x).df, x.shape, False, (2, 2))
    save_txt(a, str(tmp_path / "t"))
    np.testing.assert_array_equal(np.loadtxt(tmp_path / "t" / "1_0"), x[2:, :2])
    save_txt(a, str(tmp_path / "m"), merge_rows=True)
    np.testing.assert_array_equal(np.loadtxt(tmp_path / "m" / "0"), x[:2])


def test_trajectory(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(5, 36)).round(3) * 10
    lines = ["title"]
    for frame in x:
        lines += ["".join(f"{v:8.3f}" for v in frame[k : k + 10]) for k in range(0, 36, 10)]
    (tmp_path / "t.mdcrd").write_text("\n".join(lines) + "\n")
    np.testing.assert_allclose(got(load_mdcrd_file(str(tmp_path / "t.mdcrd"), None, 12)), x, atol=1e-9)


def test_tensor(spark, tmp_path):
    x = np.arange(48.0).reshape(6, 2, 4)
    t = T.from_array(x, (3, 1))
    assert t.tensor_shape == (2, 2, 4) and t.number_samples == 6 and t.n_tensors == 3
    np.testing.assert_array_equal((t + t - 1).collect()[2][0], 2 * x[4:] - 1)
    np.testing.assert_array_equal(((t * 2) ** 2 / 4).collect()[0][0], x[:2] ** 2)
    np.testing.assert_array_equal(T.rechunk_tensor(t, 3).collect()[1][0], x[3:])
    np.testing.assert_array_equal(t.apply_to_tensors(lambda v: v.sum(axis=2)).collect()[1][0], x[2:4].sum(axis=2))
    np.testing.assert_array_equal(T.change_shape(t, (2, 8)).collect()[0][0], x[:2].reshape(2, 8))
    np.testing.assert_array_equal(T.cat([t, t]).collect()[5][0], x[4:])
    assert T.cat([t, t], 1).shape == (3, 2)
    a, b = T.shuffle(t, t, 5)
    np.testing.assert_array_equal(a.collect(), b.collect())
    assert sorted(np.ravel(a.collect()).tolist()) == sorted(x.ravel().tolist())
    np.testing.assert_array_equal(t[1:3].collect()[0][0], x[2:4])
    t[0, 0] = np.zeros((2, 2, 4))
    assert (t.collect()[0][0] == 0).all()
    r = A.DsArray(A.array(x.reshape(6, 8)).df, (6, 8), False, (3, 8))
    np.testing.assert_array_equal(T.from_ds_array(r, (3, 2, 4)).collect()[1][0], x[3:])
    assert np.shape(T.random_tensors("np", (2, 2), (3, 4)).collect()) == (2, 2, 3, 4)
    np.save(tmp_path / "a.npy", x)
    assert T.load_dataset(2, str(tmp_path)).shape == (2, 1)
    for bad, error in ((lambda: t + T.from_array(x, (2, 1)), ValueError), (lambda: t * t, NotImplementedError), (lambda: t[9], IndexError), (lambda: T.random_tensors("jax", (1, 1), (1, 1)), ValueError), (lambda: T.load_dataset(1, str(tmp_path / "none")), NotImplementedError)):
        with pytest.raises(error):
            bad()
