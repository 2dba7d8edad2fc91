import math

import numpy as np
import pytest

from blockframe import dsarray as A
from blockframe.classification import CascadeSVM, KNeighborsClassifier
from blockframe.cluster import DBSCAN, Daura, GaussianMixture, KMeans
from blockframe.cluster.mixture import ConvergenceWarning
from blockframe.decomposition import PCA
from blockframe.estimator import NotFitted
from blockframe.model_selection import GridSearchCV, RandomizedSearchCV, SimulationGridSearch, infer_cv, parameter_grid, rank_min
from blockframe.nn import DEFAULTS, DistributedTraining, Mlp, average_parameters
from blockframe.operators.ordering import KFold, TeraSort, quantile_points, shuffle, train_test_split
from blockframe.operators.proximity import NearestNeighbors, range_join
from blockframe.preprocessing import MinMaxScaler, StandardScaler
from blockframe.recommendation import ALS
from blockframe.regression import Lasso, LinearRegression
from blockframe.trees import DecisionTreeClassifier, DecisionTreeRegressor, RandomForestClassifier, RandomForestRegressor, best_split, resolve_split_points, resolve_try_features


def got(a):
    return np.asarray(a.collect(squeeze=False))


def column(v):
    return A.array(np.asarray(v, float).reshape(-1, 1))


@pytest.fixture(scope="module")
def blobs():
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(c, 0.6, size=(60, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    p = r.permutation(180)
    return x[p], np.repeat([0.0, 1, 2], 60)[p]


def test_scalers(spark):
    x = np.random.default_rng(1).normal(size=(40, 3)) * [1, 100, 0.01]
    a = A.array(x)
    s = StandardScaler()
    t = s.fit_transform(a)
    np.testing.assert_allclose(got(t), (x - x.mean(0)) / x.std(0))
    np.testing.assert_allclose(got(s.inverse_transform(t)), x)
    s = MinMaxScaler((1, 3))
    t = s.fit_transform(a)
    np.testing.assert_allclose(got(t), (x - x.min(0)) / (x.max(0) - x.min(0)) * 2 + 1)
    np.testing.assert_allclose(got(s.inverse_transform(t)), x)
    constant = A.array(np.full((3, 1), 5.0))
    assert (got(MinMaxScaler((2, 4)).fit_transform(constant)) == 2).all()
    assert np.isnan(got(StandardScaler().fit_transform(constant))).all()
    for s in (StandardScaler(), MinMaxScaler()):
        with pytest.raises(NotFitted):
            s.transform(a)


def test_pca(spark):
    r = np.random.RandomState(8)
    x = np.vstack([r.multivariate_normal(np.full(5, i), np.eye(5), 50) for i in range(3)])
    a, p = A.array(x), PCA()
    t = p.fit_transform(a)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(got(p.explained_variance_)[0], values[::-1])
    np.testing.assert_allclose(abs(got(p.components_)), abs(vectors.T[::-1]), atol=1e-8)
    c = got(p.components_)
    assert (c[np.arange(5), abs(c).argmax(1)] > 0).all()
    np.testing.assert_allclose(got(t), (x - x.mean(0)) @ c.T, atol=1e-9)
    np.testing.assert_allclose(got(PCA(2, method="svd").fit(a).components_), c[:2], atol=1e-8)


def test_kmeans(spark):
    x = A.array(np.array([[1, 2], [2, 1], [-1, -2], [-2, -1.0]]))
    k = KMeans(2, random_state=666).fit(x)
    assert sorted(map(tuple, k.centers.tolist())) == [(-1.5, -1.5), (1.5, 1.5)]
    label = got(k.predict(A.array(np.array([[1, 2], [2, 1], [-1, -2], [-2, -1], [10, 10], [-10, -10.0]]))))[:, 0]
    assert label[0] == label[1] == label[4] != label[2] == label[3] == label[5]
    k = KMeans(3, init=np.array([[1, 1], [-1, -1], [1e6, 1e6]]), max_iter=3).fit(x)
    assert k.centers[2].tolist() == [1e6, 1e6]  # an empty cluster keeps its centre
    for init in ("first", np.zeros((3, 2))):
        with pytest.raises(ValueError):
            KMeans(2, init=init).fit(x)


def test_gaussian_mixture(spark):
    x = A.array(np.array([[1, 2], [2, 1], [-3, -3], [-1, -2], [-2, -1], [3, 3.0]]))
    g = GaussianMixture(2, random_state=666).fit(x)
    np.testing.assert_allclose(g.weights_, [0.5, 0.5], atol=1e-3)
    np.testing.assert_allclose(np.sort(g.means_[:, 0]), [-2, 2], atol=1e-3)
    np.testing.assert_allclose(g.covariances_, [[[0.66671688, 0.33338255], [0.33338255, 0.66671688]]] * 2, atol=1e-4)
    np.testing.assert_allclose(g.precisions_cholesky_[0], [[1.22469875, -0.70714834], [0, 1.4141944]], atol=1e-3)
    for kind in ("tied", "diag", "spherical"):
        label = got(GaussianMixture(2, kind, random_state=666).fit_predict(x))[:, 0]
        assert label[0] == label[1] == label[5] != label[2] == label[3] == label[4]
    with pytest.warns(ConvergenceWarning):
        GaussianMixture(2, max_iter=1, tol=0, init_params="random").fit(x)
    for bad in ({"n_components": 0}, {"tol": -1}, {"covariance_type": "round"}, {"init_params": "best"}, {"weights_init": [1]}, {"means_init": [[1, 2]]}, {"precisions_init": [[1]]}, {"reg_covar": -1}, {"max_iter": 0}):
        with pytest.raises(ValueError):
            GaussianMixture(**{"n_components": 2} | bad).fit(x)


def _dbscan(x, eps, least):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = d <= eps**2
    core = near.sum(1) >= least
    label = -np.ones(len(x))
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            label[i] = stack = max(label) + 1
            stack = [i]
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[j] = label[i]
                    stack.append(j)
    out = label.copy()
    for i in np.flatnonzero(~core):
        v = np.where(core & near[i], d[i], np.inf)
        if np.isfinite(v.min()):
            out[i] = label[v.argmin()]
    return out


def test_dbscan(spark, blobs):
    x = blobs[0]
    want = _dbscan(x, 0.3, 5)
    for options in ({}, {"n_regions": 5, "dimensions": [1]}, {"n_regions": 3, "dimensions": [0, 1]}):
        d = DBSCAN(0.3, min_samples=5, **options)
        np.testing.assert_array_equal(got(d.fit_predict(A.array(x)))[:, 0], want)
        assert d.n_clusters == want.max() + 1
    toy = A.array(np.array([[1, 2], [2, 2], [2, 3], [8, 7], [8, 8], [25, 80.0]]))
    assert got(DBSCAN(3, min_samples=2).fit_predict(toy))[:, 0].tolist() == [0, 0, 0, 1, 1, -1]
    assert (got(DBSCAN(0.1, min_samples=2).fit_predict(A.array(np.arange(4.0).reshape(-1, 1)))) == -1).all()


def test_daura(spark):
    d = np.array([[0, 0.12, 0.19, 0.21, 0.29], [0.12, 0, 0.14, 0.3, 0.4], [0.19, 0.14, 0, 0.3, 0.4], [0.21, 0.3, 0.3, 0, 0.1], [0.29, 0.4, 0.4, 0.1, 0]])
    assert Daura(0.17).fit_predict(A.array(d)) == [[1, 0, 2], [3, 4]]
    assert Daura(0.01).fit_predict(A.array(d)) == []


def test_neighbours(spark, blobs):
    x, y = blobs
    x = np.vstack([x, x[:5]])  # ties
    d = ((x[:9, None] - x[None]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    distance, index = NearestNeighbors(4).fit(A.array(x)).kneighbors(A.array(x[:9]))
    np.testing.assert_array_equal(got(index), order)
    np.testing.assert_allclose(got(distance), np.sqrt(np.take_along_axis(d, order, 1)))
    assert NearestNeighbors(99).fit(A.array(x[:3])).kneighbors(A.array(x[:1]), return_distance=False).shape == (1, 3)
    pairs = range_join(A.array(x).df, A.array(x).df, 0.5)
    full = ((x[:, None] - x[None]) ** 2).sum(2)
    assert {(r.i, r.j) for r in pairs.collect()} == set(zip(*(v.tolist() for v in np.nonzero(full <= 0.25)), strict=True))


def test_classifiers(spark, blobs, tmp_path):
    x, y = blobs
    X, Y, V, W = A.array(x[:120]), column(y[:120]), A.array(x[120:]), column(y[120:])
    for weights in ("uniform", "distance", lambda d: 1 / (1 + d)):
        assert KNeighborsClassifier(5, weights=weights).fit(X, Y).score(V, W) > 0.9
    k = KNeighborsClassifier(3).fit(X, Y)
    k.save_model(str(tmp_path / "knn"))
    np.testing.assert_array_equal(got(KNeighborsClassifier.load_model(str(tmp_path / "knn")).predict(V)), got(k.predict(V)))
    for kernel in ("rbf", "linear"):
        assert CascadeSVM(kernel=kernel, max_iter=2, block_rows=40).fit(X, Y).score(V, W) > 0.9
    two = y < 2
    s = CascadeSVM(block_rows=30).fit(A.array(x[two]), column(y[two]))
    assert s.converged and s.score(A.array(x[two]), column(y[two])) > 0.95
    s.save_model(str(tmp_path / "svm"))
    np.testing.assert_allclose(got(CascadeSVM.load_model(str(tmp_path / "svm")).decision_function(V)), got(s.decision_function(V)))
    for bad in ({"cascade_arity": 1}, {"max_iter": 0}, {"kernel": "cubic"}, {"c": 0}, {"gamma": -1}):
        with pytest.raises(AssertionError):
            CascadeSVM(**bad)


def test_linear_models(spark):
    m = LinearRegression().fit(column([1, 2, 3, 4, 5]), column([2, 1, 1, 2, 4.5]))
    np.testing.assert_allclose([m.coef_.collect(), m.intercept_.collect()], [0.6, 0.3])
    np.testing.assert_allclose(m.predict(column([3, 5, 6])).collect(), [2.1, 3.3, 3.9])
    m = LinearRegression().fit(A.array(np.array([[1, 2], [2, 0], [3, 1], [4, 4], [5, 3.0]])), column([2, 1, 1, 2, 4.5]))
    np.testing.assert_allclose(m.coef_.collect(), [0.421875, 0.296875])
    np.testing.assert_allclose(m.intercept_.collect(), 0.240625)
    with pytest.raises(np.linalg.LinAlgError):
        LinearRegression(fit_intercept=False).fit(A.zeros((3, 2)), column([1, 2, 3]))
    r = np.random.RandomState(42)
    x = r.randn(50, 100)
    c = ((-1.0) ** np.arange(100)) * np.exp(-np.arange(100) / 10)
    c[10:] = 0
    y = x @ c + 0.01 * r.normal(size=50)
    score = Lasso(lmbd=0.1, max_iter=50, block_rows=5).fit(A.array(x[:25]), column(y[:25])).score(A.array(x[25:]), column(y[25:]))
    assert score == pytest.approx(0.9481783421045813, abs=1e-4)


def test_als(spark, tmp_path):
    m = ALS(random_state=0, n_f=5, max_iter=20).fit(A.array(np.array([[0, 0, 5], [3, 0, 5], [3, 1, 2.0]])).to_sparse())
    p = m.predict_user(0)
    assert 2.5 < p[0] < 3.5 and p[1] < 1 and p[2] > 4.5
    with pytest.raises(IndexError):
        m.predict_user(3)
    m.save_model(str(tmp_path / "als"))
    np.testing.assert_allclose(ALS.load_model(str(tmp_path / "als")).predict_user(0), p)
    with pytest.raises(ValueError):
        ALS().fit(A.array(np.ones((2, 2))))


def test_trees(spark, blobs, tmp_path):
    x, y = blobs
    X, Y = A.array(x), column(y)
    for model in (RandomForestClassifier(5, max_depth=5, random_state=1), RandomForestClassifier(5, max_depth=5, hard_vote=True, random_state=1), DecisionTreeClassifier(max_depth=5)):
        assert model.fit(X, Y).score(X, Y) > 0.9
        np.testing.assert_allclose(got(model.predict_proba(X)).sum(1), 1)
    for model in (RandomForestRegressor(5, try_features=None, max_depth=5, random_state=1), DecisionTreeRegressor(max_depth=5)):
        assert model.fit(X, Y).score(X, Y) > 0.85
    model.save_model(str(tmp_path / "tree"))
    assert type(model).load_model(str(tmp_path / "tree")).score(X, Y) == pytest.approx(model.score(X, Y))
    assert [resolve_try_features(t, 9) for t in (None, "sqrt", "third", 4, 0.5)] == [9, 3, 3, 4, 4]
    assert [resolve_split_points(t, 100) for t in ("auto", "sqrt", 7, 0.25)] == [4, 10, 7, 25]
    with pytest.raises(ValueError):
        RandomForestClassifier(split_computation="exactly")


@pytest.mark.parametrize("form", ["json", "pickle"])
def test_save_and_load(spark, blobs, tmp_path, form):
    x, y = A.array(blobs[0]), column(blobs[1])
    models = [KMeans(3, random_state=1).fit(x), GaussianMixture(2, random_state=1).fit(x), PCA(1).fit(x), StandardScaler().fit(x), MinMaxScaler().fit(x), LinearRegression().fit(x, y), Lasso(max_iter=3).fit(x, y)]
    for m in models:
        path = str(tmp_path / f"{type(m).__name__}.{form}")
        m.save_model(path, save_format=form)
        back = type(m).load_model(path, load_format=form)
        use = "transform" if hasattr(m, "transform") else "predict"
        np.testing.assert_allclose(got(getattr(back, use)(x)), got(getattr(m, use)(x)))
    with pytest.raises(ValueError):
        m.save_model(path, save_format="txt")
    with pytest.raises(ValueError):
        type(m).load_model(path, load_format="txt")
    with pytest.raises(ValueError):
        PCA.load_model(path, load_format=form)


def test_sorts_and_splits(spark):
    np.testing.assert_array_equal(TeraSort().sort(A.array(np.array([[258, 129, 528, 248, 0.0]]))).collect(), [0, 129, 248, 258, 528])
    x = np.array([[0, 1, 2, 3, 4], [3, 2, 1, 0, 8.0]])
    t = TeraSort([0] * 5, [9] * 5, column_indexes=[0, 1, 2, 3, 4])
    np.testing.assert_array_equal(t.sort(A.array(x)).collect(), [[0, 1, 1, 0, 4], [3, 2, 2, 3, 8]])
    assert TeraSort().fit(A.array(x)).range_max == 8
    for bad in (lambda: TeraSort(5, 5), lambda: TeraSort(num_buckets=2.5), lambda: TeraSort([0], [1, 2], [0, 1]), lambda: TeraSort().sort(x)):
        with pytest.raises(ValueError):
            bad()
    assert quantile_points(A.array(np.arange(100.0).reshape(-1, 1)), 0, 3) == pytest.approx([24, 49, 74], abs=1)
    v = np.arange(40.0).reshape(20, 2)
    a, b = shuffle(A.array(v), A.array(v), random_state=3)
    np.testing.assert_array_equal(got(a), got(b))
    assert not np.array_equal(got(a), v) and sorted(map(tuple, got(a).tolist())) == sorted(map(tuple, v.tolist()))
    train, test, y_train, y_test = train_test_split(A.array(v), A.array(v), test_size=0.25, block_rows=7)
    assert (train.shape[0], test.shape[0]) == (5 + 5 + 4, 1 + 1 + 1)
    np.testing.assert_array_equal(got(train), got(y_train))
    assert not {tuple(r) for r in got(train).tolist()} & {tuple(r) for r in got(test).tolist()}
    for bad in ({"test_size": 1.5}, {"test_size": 0.6, "train_size": 0.6}):
        with pytest.raises(ValueError):
            train_test_split(A.array(v), **bad)
    folds = list(KFold(3).split(A.array(v), A.array(v)))
    assert [test[0].shape[0] for _, test in folds] == [7, 7, 6]
    np.testing.assert_array_equal(got(folds[1][0][0]), np.vstack([v[:7], v[14:]]))
    assert infer_cv(None).get_n_splits() == 5 and infer_cv(3).get_n_splits() == 3
    for bad, error in (({"n_splits": 1}, ValueError), ({"n_splits": 2.5}, ValueError), ({"shuffle": 1}, TypeError)):
        with pytest.raises(error):
            KFold(**bad)


def test_searches(spark, blobs):
    x, y = A.array(blobs[0]), column(blobs[1])
    g = GridSearchCV(KNeighborsClassifier(), {"n_neighbors": [1, 5]}, cv=2).fit(x, y)
    assert set(g.cv_results_) >= {"param_n_neighbors", "params", "split0_test_score", "mean_test_score", "std_test_score", "rank_test_score"}
    assert g.best_params_ == g.cv_results_["params"][g.best_index_] and g.best_estimator_.predict(x).shape == (180, 1)
    r = RandomizedSearchCV(KNeighborsClassifier(), {"n_neighbors": [1, 3, 5]}, n_iter=2, cv=2, refit=False, random_state=1).fit(x, y)
    assert len(r.cv_results_["params"]) == 2
    s = SimulationGridSearch(lambda a, b: a * b, {"a": [1, 2], "b": [3, 4]}, sim_number=2).fit()
    assert s.best_params_ == {"a": 2, "b": 4}
    assert rank_min([3, 1, 3, 2]).tolist() == [1, 4, 1, 3]
    assert parameter_grid([{"a": [1]}, {"b": [2, 3]}]) == [{"a": 1}, {"b": 2}, {"b": 3}]
    for bad in ({"a": 1}, {"a": []}, {"a": "xy"}):
        with pytest.raises(ValueError):
            parameter_grid(bad)
    with pytest.raises(NotImplementedError):
        SimulationGridSearch(3, {})
    with pytest.raises(TypeError):
        GridSearchCV(StandardScaler(), {}).fit(x)


def test_networks(spark, blobs):
    x, y = blobs
    X, Y = A.array(x), A.array(np.eye(3)[y.astype(int)])
    for name in DEFAULTS:
        t = DistributedTraining(3).build(Mlp([2, 16, 3], random_state=1), name, optimizer_parameters={"lr": 0.05} if name != "adadelta" else None)
        t.fit_synchronous_with_GPU(X, Y, 8, 5)
        assert (got(t.predict(X)).argmax(1) == y).mean() > 0.5, name
    t.fit_asynchronous_shuffle_n_epochs_with_GPU(X, Y, 8, 4, 2)
    assert [p.shape for p in t.get_parameters()] == [(2, 16), (16,), (16, 3), (3,)]
    net = Mlp([2, 4, 3], random_state=2)
    v, goal = x[:7], np.eye(3)[y[:7].astype(int)]

    def loss(w):
        return -np.log(net.forward(w, v)[-1][np.arange(7), y[:7].astype(int)]).mean()

    g = net.gradient(net.weights, v, goal)
    for k in range(0, len(g), 5):
        e = np.eye(len(g))[k] * 1e-6
        assert g[k] == pytest.approx((loss(net.weights + e) - loss(net.weights - e)) / 2e-6, abs=1e-5)
    with pytest.raises(ValueError):
        DistributedTraining(2).build(net, "newton")
    assert math.isfinite(loss(net.weights))


def test_average_and_splits(spark):
    mean = average_parameters([[np.ones((2, 2)), np.zeros(2)], [np.full((2, 2), 3.0), np.ones(2)]])
    assert (mean[0] == 2).all() and (mean[1] == 0.5).all()
    with pytest.raises(ValueError):
        average_parameters([])
    r = np.random.default_rng(5)
    rows = [(float(r.integers(0, 9)), "ab"[int(r.integers(0, 2))], float(r.normal())) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, c string, y double").repartition(5)
    values = sorted({v for v, _, _ in rows})
    for classes in (True, False):
        best = []
        for a, b in zip(values, values[1:], strict=False):
            score = 0.0
            for side in ([v for v in rows if v[0] <= a], [v for v in rows if v[0] >= b]):
                if classes:
                    score -= sum(sum(v[1] == c for v in side) ** 2 for c in "ab") / len(side)
                else:
                    score -= sum(v[2] for v in side) ** 2 / len(side)
            best.append((score, -(a + b) / 2))
        found = best_split(df, "x", "c" if classes else "y", classes).first()
        assert (found.score, -found.threshold) == pytest.approx(min(best))
    assert best_split(df.limit(0), "x", "c").count() == 0
