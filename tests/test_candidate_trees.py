import numpy as np
import pytest

from blockframe import array, candidate_trees
from blockframe.trees import DecisionTreeClassifier, DecisionTreeRegressor, RandomForestClassifier, RandomForestRegressor

KINDS = ("raw", "gaussian_approximation", "uniform_approximation")


def column(v):
    return array(np.asarray(v, float).reshape(-1, 1))


@pytest.fixture(scope="module")
def blobs():
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(c, 0.6, size=(80, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    p = r.permutation(240)
    return x[p], np.repeat([5.0, 1, 2], 80)[p]


@pytest.mark.parametrize("kind", KINDS)
def test_classes_and_values(spark, blobs, kind, tmp_path):
    x, y = blobs
    a = array(x)
    for model in (DecisionTreeClassifier(try_features=None, max_depth=4, mmap=False, split_computation=kind, random_state=1, n_split_points=8), RandomForestClassifier(4, try_features=None, max_depth=3, mmap=False, split_computation=kind, random_state=1, n_split_points=8)):
        assert model.fit(a, column(y)).score(a, column(y)) > 0.9
        np.testing.assert_allclose(model.predict_proba(a).collect(squeeze=False).sum(axis=1), 1)
    model.save_model(str(tmp_path / "m"), save_format="pickle")
    np.testing.assert_array_equal(RandomForestClassifier.load_model(str(tmp_path / "m"), "pickle").predict(a).collect(), model.predict(a).collect())
    with pytest.raises(ValueError):
        model.save_model(str(tmp_path / "n"))
    z = 3 * x[:, 0] - x[:, 1]
    for model in (DecisionTreeRegressor(try_features=None, max_depth=5, mmap=False, split_computation=kind, n_split_points=10), RandomForestRegressor(4, try_features=None, max_depth=4, mmap=False, split_computation=kind, random_state=1, n_split_points=10)):
        assert model.fit(a, column(z)).score(a, column(z)) > 0.7


def test_first_split_is_the_best_candidate(spark):
    r = np.random.default_rng(1)
    x, y = r.random((300, 3)), r.integers(0, 3, 300)
    y = np.where(x[:, 1] > 0.6, 2, y)
    model = DecisionTreeClassifier(try_features=None, max_depth=1, mmap=False, split_computation="uniform_approximation", n_split_points=9, range_min=0.0, range_max=1.0).fit(array(x), column(y))
    best = None
    for j in range(3):
        for t in np.arange(1, 10) / 10:
            left = x[:, j] <= t
            if min(left.sum(), (~left).sum()) < candidate_trees.LEAST_SIDE:
                continue
            gain = sum((np.bincount(y[s], minlength=3) ** 2).sum() / s.sum() for s in (left, ~left))
            if best is None or gain > best[0] + 1e-9:
                best = (gain, j, t)
    tree = model.forest_[0]
    assert tree.feature[0] == best[1] and tree.threshold[0] == pytest.approx(best[2])
    assert len(tree.feature) == 3


def test_limits(spark):
    x = np.arange(12.0).reshape(-1, 1)
    y = (x[:, 0] >= 6).astype(float)
    tree = DecisionTreeClassifier(mmap=False, n_split_points=11).fit(array(x), column(y)).forest_[0]
    assert len(tree.feature) == 3 and 5 <= tree.threshold[0] < 6  # both sides are pure
    tree = DecisionTreeClassifier(mmap=False, n_split_points=11).fit(array(x[:7]), column(y[:7])).forest_[0]
    assert tree.feature == [-1]  # no split leaves four rows on either side
    assert DecisionTreeClassifier(mmap=False).fit(array(x), column(y * 0)).forest_[0].feature == [-1]
    with pytest.raises(ValueError):
        RandomForestClassifier(max_depth=40)


def test_weights_are_poisson_and_follow_from_rows():
    rows = np.arange(20_000)
    w = candidate_trees.weights(rows, 3, 7, True)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06
    np.testing.assert_array_equal(w[::-1], candidate_trees.weights(rows[::-1], 3, 7, True))
    assert (candidate_trees.weights(rows, 4, 7, True) != w).mean() > 0.3


def test_depth_is_not_cut(spark):
    x = np.arange(256.0).reshape(-1, 1)
    y = (np.arange(256) // 8) % 2
    model = DecisionTreeClassifier(mmap=False, n_split_points=200).fit(array(x), column(y))
    assert model.score(array(x), column(y)) == 1.0
