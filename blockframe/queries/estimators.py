"""Queries of scalers, decompositions, neighbours, clustering, models and scores, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe import dsarray as A
from blockframe import linalg
from blockframe.classification import CascadeSVM, KNeighborsClassifier
from blockframe.classification.knn import accuracy
from blockframe.cluster import DBSCAN, Daura, GaussianMixture, KMeans
from blockframe.decomposition import PCA, covariance
from blockframe.functions.reductions import by_column
from blockframe.model_selection import GridSearchCV
from blockframe.nn import DistributedTraining, Mlp
from blockframe.operators.proximity import NearestNeighbors, range_join
from blockframe.plans.runtime import table
from blockframe.preprocessing import MinMaxScaler, StandardScaler
from blockframe.queries.arrays import embeddings, labels, libsvm, long
from blockframe.recommendation import ALS
from blockframe.regression import Lasso, LinearRegression, r2_score
from blockframe.trees import DecisionTreeClassifier, RandomForestClassifier, RandomForestRegressor, best_split

D4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
K = 4


def line_items(spark: SparkSession, sf_dir: str) -> A.DsArray:
    """Numbers of lineitem, its rows numbered from 0 in the order of their keys and values."""
    from blockframe.plans.index import dense_index

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *D4)
    return A.from_rows(dense_index(rows, ["l_orderkey", "l_linenumber", *D4]), "row_idx", D4)


def wide(a: A.DsArray, places: int = 6) -> DataFrame:
    """(row_idx, x0, x1, ...) with rounded values."""
    cells = [(F.round(F.get("features", F.lit(k)), places) + F.lit(0.0)).alias(f"x{k}") for k in range(a.shape[1])]
    return a.df.select("row_idx", *cells)


def _scaled(make: Callable, inverse: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = line_items(spark, sf_dir)
        scaler = make().fit(x)
        return wide(scaler.inverse_transform(scaler.transform(x)) if inverse else scaler.transform(x))

    return run


def _values(name: str, values) -> Callable[[SparkSession, str], DataFrame]:
    """Rows (k, name) of a small vector."""
    return lambda spark, sf_dir: spark.createDataFrame([(k, float(v)) for k, v in enumerate(np.asarray(values(spark, sf_dir)).ravel())], f"k int, {name} double")


def _covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(A.array(covariance(embeddings(spark, sf_dir))[1]))


def fiftieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of every search: rows whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("row_idx"), F.col("embedding").cast("array<double>").alias("features"))


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    from blockframe.operators.proximity import top_k

    x = embeddings(spark, sf_dir)
    return top_k(x.df, fiftieth(spark, sf_dir), k, x.shape[1])


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 5).select("q", F.col("rank").cast("bigint").alias("rank"), "idx", F.round(F.sqrt("d2"), 6).alias("distance"))


def _classified(weights: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, y = embeddings(spark, sf_dir), labels(spark, sf_dir)
        q = A.DsArray(fiftieth(spark, sf_dir), x.shape)
        predicted = KNeighborsClassifier(5, weights=weights).fit(x, y).predict(q)
        return predicted.df.select("row_idx", F.get("features", F.lit(0)).cast("int").alias("label"))

    return run


def _knn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = embeddings(spark, sf_dir), labels(spark, sf_dir)
    score = KNeighborsClassifier(5).fit(x, y).score(A.DsArray(fiftieth(spark, sf_dir), x.shape), y)
    return spark.createDataFrame([(round(score, 6),)], "accuracy double")


def _range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.array("c_acctbal").alias("features"))
    return range_join(rows, rows, 0.5, [0]).select("i", "j", F.round("d", 6).alias("d"))


def suppliers(spark: SparkSession, sf_dir: str) -> A.DsArray:
    """Suppliers as points (balance in thousands, nation), numbered from 0 in the order of their keys."""
    from blockframe.plans.index import dense_index

    rows = dense_index(table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y")), ["s_suppkey"])
    return A.from_rows(rows, "row_idx", ["x", "y"])


def _dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = DBSCAN(eps=1.25, min_samples=4).fit_predict(suppliers(spark, sf_dir))
    return found.df.select("row_idx", F.get("features", F.lit(0)).cast("int").alias("label"))


def _daura_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Daura(1.0).near(suppliers(spark, sf_dir))


def _daura(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster's centre, and its members with the centre among them."""
    x, model = suppliers(spark, sf_dir), Daura(1.0)
    found = model.clusters_of(model.near(x), x.shape[0])
    return found.select("centre", "member").unionByName(found.select("centre", F.col("centre").alias("member")).distinct())


def _kmeans(passes: int) -> Callable[[SparkSession, str], KMeans]:
    def run(spark: SparkSession, sf_dir: str) -> KMeans:
        x = embeddings(spark, sf_dir)
        start = np.asarray(x[0:K].collect(squeeze=False))
        return KMeans(K, init=start, max_iter=passes, tol=0).fit(x)

    return run


def _centres(passes: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: long(A.array(_kmeans(passes)(spark, sf_dir).centers))


def _kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _kmeans(3)(spark, sf_dir).predict(embeddings(spark, sf_dir))
    return found.df.select("row_idx", F.get("features", F.lit(0)).cast("int").alias("label"))


def _regression(columns: list[str]) -> Callable[[SparkSession, str], tuple[LinearRegression, A.DsArray, A.DsArray]]:
    def run(spark: SparkSession, sf_dir: str):
        from blockframe.plans.index import dense_index

        rows = dense_index(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *D4), ["l_orderkey", "l_linenumber", *D4])
        n = rows.count()
        x, y = A.from_rows(rows, "row_idx", columns, n), A.from_rows(rows, "row_idx", ["l_extendedprice"], n)
        return LinearRegression().fit(x, y), x, y

    return run


def _coefficients(columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = _regression(columns)(spark, sf_dir)[0]
        values = [*np.asarray(model.coef_.collect(squeeze=False)).ravel(), float(model.intercept_.collect())]
        return spark.createDataFrame([tuple(round(float(v), 3) for v in values)], ", ".join([*[f"b{k} double" for k in range(len(columns))], "intercept double"]))

    return run


def _r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, x, y = _regression(["l_quantity"])(spark, sf_dir)
    return spark.createDataFrame([(round(r2_score(model.predict(x), y), 6),)], "r2 double")


def _majority_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = labels(spark, sf_dir)
    return spark.createDataFrame([(round(accuracy(y * 0 + 3.0, y), 6),)], "accuracy double")


def _split(classes: bool) -> Callable[[SparkSession, str], DataFrame]:
    label = "l_returnflag" if classes else "l_extendedprice"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = best_split(table(spark, sf_dir, "lineitem"), "l_quantity", label, classes)
        return found.select("threshold", F.round("score", 4 if classes else 0).alias("score"))

    return run


def zero(x: np.ndarray, scale: float = 1.0, places: int = 6) -> float:
    """The largest size of values that should vanish against ``scale``, rounded."""
    return float(round(float(np.max(np.abs(x), initial=0.0)) / max(scale, 1e-300), places)) + 0.0


def _pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance matrix that all components and their variances make."""
    model = PCA().fit(embeddings(spark, sf_dir))
    components, values = (np.asarray(a.collect(squeeze=False)) for a in (model.components_, model.explained_variance_))
    return long(A.array(components.T * values[0] @ components))


def _pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred rows: the transformed rows, turned back."""
    x = embeddings(spark, sf_dir)
    model = PCA().fit(x)
    return long(linalg.times(model.transform(x), np.asarray(model.components_.collect(squeeze=False))))


def _svd_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U S V', which is the matrix."""
    u, s, v = linalg.svd(embeddings(spark, sf_dir))
    return long(linalg.times(u * s, np.asarray(v.collect(squeeze=False)).T))


def _gram_rows(spark: SparkSession, gram: np.ndarray) -> DataFrame:
    """(i, j, v) of a small Gram matrix."""
    return long(A.array(gram))


def _svd_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U' U, which is the identity."""
    return _gram_rows(spark, linalg.cross(linalg.svd(embeddings(spark, sf_dir))[0]))


def _svd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power sums of the squared singular values a row: the traces of the powers of A'A / n."""
    x = embeddings(spark, sf_dir)
    s2 = np.asarray(linalg.svd(x, compute_uv=False).collect(squeeze=False))[0] ** 2 / max(1, x.shape[0])
    return spark.createDataFrame([(k, round(float((s2**k).sum()), 8)) for k in (1, 2, 3)], "power int, trace double")


def _tsqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R' R, and the largest value below the diagonal of R."""
    r = np.asarray(linalg.tsqr(embeddings(spark, sf_dir), "r_reduced").collect(squeeze=False))
    return long(A.array(r.T @ r)).withColumn("below", F.lit(zero(np.tril(r, -1)))).withColumn("negative", F.lit(int((np.diag(r) < 0).sum())))


def _qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q R, which is the matrix."""
    q, r = linalg.qr(embeddings(spark, sf_dir), "economic")
    return long(linalg.times(q, np.asarray(r.collect(squeeze=False))))


def _qr_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q' Q, which is the identity."""
    return _gram_rows(spark, linalg.cross(linalg.qr(embeddings(spark, sf_dir), "economic")[0]))


def _truncated(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """(k, residual, off): how far each triple is from A v = s u, and each left vector from being of length 1 and orthogonal to the others."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = embeddings(spark, sf_dir)
        u, s, v = f(x)
        values, right = np.asarray(s.collect(squeeze=False))[0], np.asarray(v.collect(squeeze=False))
        gap = linalg.cross(A.matsubtract(linalg.times(x, right), u * s))
        gram = linalg.cross(u)
        rows = [(k, zero(float(gap[k, k]) ** 0.5, float(values[0]), 3), zero(gram[k] - np.eye(len(values))[k], 1, 3)) for k in range(len(values))]
        return spark.createDataFrame(rows[:8], "k int, residual double, off double")

    return run


def _mixture(passes: int | None) -> Callable[[SparkSession, str], DataFrame]:
    """Means of three components over the suppliers, from a fixed start; ``passes`` None is to convergence."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        start = {"weights_init": [0.3, 0.3, 0.4], "means_init": START, "precisions_init": [np.eye(2) / 9] * 3}
        limit = {"check_convergence": False, "max_iter": passes} if passes else {}
        model = GaussianMixture(3, random_state=1, init_params="random", reg_covar=1e-6, **start, **limit).fit(suppliers(spark, sf_dir))
        rows = [(k, round(float(w), 6) + 0.0, *(round(float(v), 6) + 0.0 for v in mu)) for k, (w, mu) in enumerate(zip(model.weights_, model.means_, strict=True))]
        return spark.createDataFrame(rows, "k int, weight double, x double, y double")

    return run


START = [[0.0, 5.0], [5.0, 12.0], [8.0, 20.0]]


def _labelled(spark: SparkSession, sf_dir: str, model) -> DataFrame:
    x, y = embeddings(spark, sf_dir), labels(spark, sf_dir)
    found = model.fit(x, y).predict(x)
    return found.df.select("row_idx", F.get("features", F.lit(0)).alias("label"))


def _als(spark: SparkSession, sf_dir: str) -> tuple[ALS, DataFrame]:
    rows = table(spark, sf_dir, "sample_movielens_ratings").filter("c0 IS NOT NULL AND c1 IS NOT NULL AND c2 > 0")
    rated = rows.groupBy(F.col("c0").cast("bigint").alias("i"), F.col("c1").cast("bigint").alias("j")).agg(F.avg("c2").alias("v"))
    n, m = rows.agg(F.max("c0"), F.max("c1")).first()
    model = ALS(random_state=1, n_f=8, max_iter=20).fit(A.DsArray(rated, ((n or 0) + 1, (m or 0) + 1), True))
    return model, rated


def _als_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, ratings, residual): how far the factors of every item are from its normal equations, given those of the users."""
    model, rated = _als(spark, sf_dir)
    users, items = (f.select(F.col("id").alias(k), F.col("f").alias(n)) for f, k, n in ((model._users, "i", "u"), (model._items, "j", "f")))
    dot = F.aggregate(F.zip_with("u", "f", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    parts = rated.join(users, "i").join(items, "j").withColumn("r", F.col("v") - dot)
    sums = [F.sum(F.get("u", F.lit(k)) * F.col("r")).alias(f"g{k}") for k in range(model.n_f)]
    left = parts.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.first("f").alias("f"), *sums)
    gap = F.greatest(*[F.abs(F.col(f"g{k}") - model.lambda_ * F.col("n") * F.get("f", F.lit(k))) for k in range(model.n_f)]) / F.col("n")
    return left.select(F.col("j").alias("item"), F.col("n").alias("ratings"), (F.round(gap, 6) + F.lit(0.0)).alias("residual"))


def _lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, gap): how far every coefficient is from the conditions of the optimum, against the largest gradient at zero."""
    x, y = embeddings(spark, sf_dir), labels(spark, sf_dir)
    blocks, penalty = 4, 5.0
    model = Lasso(lmbd=penalty, max_iter=500, atol=1e-5, rtol=1e-4, rho=max(1.0, x.shape[0] / (64 * blocks)), block_rows=max(1, -(-x.shape[0] // blocks))).fit(x, y)
    w, gram, xy = np.asarray(model.coef_), linalg.cross(x), linalg.cross(x, y)[:, 0]
    slope, bound = xy - gram @ w, blocks * penalty
    gap = np.where(w == 0, np.maximum(0, np.abs(slope) - bound), np.abs(slope - bound * np.sign(w))) / np.abs(xy).max()
    return spark.createDataFrame([(k, round(float(g), 3) + 0.0) for k, g in enumerate(gap)], "k int, gap double")


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = embeddings(spark, sf_dir), labels(spark, sf_dir)
    hot = A.DsArray(y.df.select("row_idx", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.when(c == F.get("features", F.lit(0)).cast("int"), 1.0).otherwise(0.0)).alias("features")), (y.shape[0], 10))
    training = DistributedTraining(4).build(Mlp([64, 32, 10], random_state=1), "adam", optimizer_parameters={"lr": 0.01})
    training.fit_synchronous_shuffle_with_GPU(x, hot, 8, 3)
    found = training.predict(x).df
    return found.select("row_idx", (F.array_position("features", F.array_max("features")) - 1).cast("int").alias("label"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = embeddings(spark, sf_dir), labels(spark, sf_dir)
    found = GridSearchCV(KNeighborsClassifier(), {"n_neighbors": [1, 5]}, cv=2, refit=False).fit(x, y).cv_results_
    rows = [(int(p["n_neighbors"]), round(float(m), 6), int(r)) for p, m, r in zip(found["params"], found["mean_test_score"], found["rank_test_score"], strict=True)]
    return spark.createDataFrame(rows, "n_neighbors int, mean_score double, rank int")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scaler_standard": _scaled(StandardScaler),
    "scaler_standard_inverse": _scaled(StandardScaler, True),
    "scaler_minmax": _scaled(MinMaxScaler),
    "scaler_minmax_range": _scaled(lambda: MinMaxScaler((-1, 3))),
    "scaler_minmax_inverse": _scaled(MinMaxScaler, True),
    "covariance_matrix": _covariance,
    "column_nonzero_mean": lambda spark, sf_dir: long(by_column(libsvm(spark, sf_dir), "nonzero_mean").to_sparse(), 12),
    "knn_topk": _knn,
    "knn_classify_uniform": _classified("uniform"),
    "knn_classify_distance": _classified("distance"),
    "knn_accuracy": _knn_accuracy,
    "range_join_pairs": _range_pairs,
    "dbscan_labels": _dbscan,
    "daura_neighbours": _daura_neighbours,
    "daura_clusters": _daura,
    "kmeans_1iter": _centres(1),
    "kmeans_3iter": _centres(3),
    "kmeans_assign": _kmeans_assign,
    "linreg_uni": _coefficients(["l_quantity"]),
    "linreg_two": _coefficients(["l_quantity", "l_discount"]),
    "r2_score": _r2,
    "accuracy_score": _majority_accuracy,
    "tree_best_split_gini": _split(True),
    "tree_best_split_mse": _split(False),
    "pca_components": _pca,
    "pca_transform": _pca_transform,
    "svd_values": _svd_values,
    "svd_product": _svd_product,
    "svd_u_gram": _svd_gram,
    "tsqr_r": _tsqr,
    "qr_economic_q": _qr,
    "qr_q_gram": _qr_gram,
    "random_svd": _truncated(lambda x: linalg.random_svd(x, iters=12, epsilon=0.99, tol=1e-6, nsv=8, k=48)),
    "lanczos_svd": _truncated(lambda x: linalg.lanczos_svd(x, 32, 8, 16, 8, epsilon=0.99)),
    "gmm_full": _mixture(None),
    "gmm_3iter": _mixture(3),
    "als_item_norms": _als_items,
    "lasso_coefficients": _lasso,
    "rf_classifier": lambda spark, sf_dir: _labelled(spark, sf_dir, RandomForestClassifier(5, max_depth=5, random_state=1)),
    "rf_regressor": lambda spark, sf_dir: _labelled(spark, sf_dir, RandomForestRegressor(5, try_features="third", max_depth=5, random_state=1)),
    "dt_classifier": lambda spark, sf_dir: _labelled(spark, sf_dir, DecisionTreeClassifier(max_depth=5, random_state=1)),
    "csvm_labels": lambda spark, sf_dir: _labelled(spark, sf_dir, CascadeSVM(block_rows=500)),
    "nn_labels": _network,
    "grid_search_knn": _grid,
    "nearest_neighbors": lambda spark, sf_dir: long(NearestNeighbors(3).fit(embeddings(spark, sf_dir)).kneighbors(embeddings(spark, sf_dir))[0]),
}

_M = "m AS (SELECT vec_id AS i, generate_subscripts(embedding, 1)::BIGINT - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_E = "e AS (SELECT vec_id AS i, list_transform(embedding, lambda x: x::DOUBLE) AS x, label FROM embeddings)"


def _scale(cell: str) -> str:
    cells = [f"round({cell.format(c=c)}, 6) + 0.0 AS x{k}" for k, c in enumerate(D4)]
    return f"SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, {', '.join(D4)}) - 1 AS row_idx, {', '.join(cells)} FROM lineitem"


_D2 = "list_sum(list_transform(range(1, 65), lambda k: (q.x[k] - f.x[k]) * (q.x[k] - f.x[k])))"
_NEAR = f"""{_E}, pairs AS (SELECT q.i AS q, f.i AS idx, f.label, {_D2} AS d2 FROM e q, e f WHERE q.i % 50 = 0),
    near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d2, 12), idx) AS rank FROM pairs QUALIFY rank <= 5)"""


def _vote(weight: str) -> str:
    return f"""{_NEAR}, votes AS (SELECT q, label, sum({weight}) AS w, min(rank) AS first FROM near GROUP BY q, label),
        won AS (SELECT q, label FROM votes QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(w, 9) DESC, first) = 1)"""


_POINTS = "p AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier)"
_LINKS = "links AS (SELECT a.i AS u, b.i AS v, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM p a, p b WHERE d <= {r})"


def _lloyd(passes: int) -> str:
    parts = [_M, f"c0 AS (SELECT i AS k, j, v FROM m WHERE i < {K})"]
    for t in range(passes):
        parts += [
            f"d{t} AS (SELECT m.i, c.k, sum((m.v - c.v) * (m.v - c.v)) AS d FROM m JOIN c{t} c ON m.j = c.j GROUP BY m.i, c.k)",
            f"a{t} AS (SELECT i, k FROM d{t} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, k) = 1)",
            f"c{t + 1} AS (SELECT c.k, c.j, coalesce(n.v, c.v) AS v FROM c{t} c LEFT JOIN (SELECT a.k, m.j, avg(m.v) AS v FROM a{t} a JOIN m ON a.i = m.i GROUP BY a.k, m.j) n ON n.k = c.k AND n.j = c.j)",
        ]
    return "WITH " + ", ".join(parts)


_IDENTITY = "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(64) a(i), range(64) b(j)"
_VANISHED = "SELECT k::INT AS k, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS off FROM range(8) t(k)"


def _em(passes: int) -> str:
    """Expectation maximisation of three components in two dimensions, with closed inverses and determinants."""
    start = ", ".join(f"({k}, {w}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE, 9.0::DOUBLE, 0.0::DOUBLE, 9.0::DOUBLE)" for k, (w, (x, y)) in enumerate(zip((0.3, 0.3, 0.4), START, strict=True)))
    parts = [_POINTS, f"g0 AS (SELECT * FROM (VALUES {start}) t(k, w, mx, my, a, b, c))"]
    for t in range(passes):
        parts += [
            f"""f{t} AS (SELECT p.i, p.x, p.y, k, ln(w) - 0.5 * ln(a * c - b * b) - 0.5 * (c * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * c - b * b) AS l FROM p, g{t})""",
            f"r{t} AS (SELECT i, x, y, k, exp(l - max(l) OVER (PARTITION BY i)) AS e FROM f{t})",
            f"s{t} AS (SELECT x, y, k, e / sum(e) OVER (PARTITION BY i) AS r FROM r{t})",
            f"n{t} AS (SELECT k, sum(r) AS n, sum(r * x) / sum(r) AS mx, sum(r * y) / sum(r) AS my FROM s{t} GROUP BY k)",
            f"""g{t + 1} AS (SELECT s.k, any_value(n.n) / (SELECT count(*) FROM p) AS w, any_value(n.mx) AS mx, any_value(n.my) AS my, sum(r * (x - n.mx) * (x - n.mx)) / any_value(n.n) + 1e-6 AS a,
                sum(r * (x - n.mx) * (y - n.my)) / any_value(n.n) AS b, sum(r * (y - n.my) * (y - n.my)) / any_value(n.n) + 1e-6 AS c FROM s{t} s JOIN n{t} n ON s.k = n.k GROUP BY s.k)""",
        ]
    return f"WITH {', '.join(parts)} SELECT k::INT AS k, round(w, 6) + 0.0 AS weight, round(mx, 6) + 0.0 AS x, round(my, 6) + 0.0 AS y FROM g{passes}"


_SUMS = "SELECT avg(l_quantity) AS ax, avg(l_discount) AS az, avg(l_extendedprice) AS ay, var_pop(l_quantity) AS xx, var_pop(l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS zy FROM lineitem"
ORACLES = {
    "scaler_standard": _scale("({c} - avg({c}) OVER ()) / sqrt(var_pop({c}) OVER ())"),
    "scaler_standard_inverse": _scale("{c}"),
    "scaler_minmax": _scale("({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"),
    "scaler_minmax_range": _scale("({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 4 - 1"),
    "scaler_minmax_inverse": _scale("{c}"),
    "covariance_matrix": f"WITH {_M} SELECT a.j AS i, b.j AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j",
    "column_nonzero_mean": "SELECT 0::BIGINT AS i, j, round(avg(v), 12) + 0.0 AS v FROM (SELECT i, j - 1 AS j, sum(v) AS v FROM libsvm_entries WHERE v IS NOT NULL GROUP BY i, j HAVING sum(v) <> 0) GROUP BY j HAVING avg(v) <> 0",
    "knn_topk": f"WITH {_NEAR} SELECT q, rank, idx, round(sqrt(d2), 6) AS distance FROM near",
    "knn_classify_uniform": f"WITH {_vote('1')} SELECT q AS row_idx, label FROM won",
    "knn_classify_distance": f"WITH {_vote('1 / (sqrt(d2) + 2.220446049250313e-16)')} SELECT q AS row_idx, label FROM won",
    "knn_accuracy": f"WITH {_vote('1')} SELECT round(avg(CASE WHEN won.label = e.label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM won JOIN e ON e.i = won.q",
    "range_join_pairs": "SELECT a.c_custkey AS i, b.c_custkey AS j, round(abs(a.c_acctbal - b.c_acctbal), 6) AS d FROM customer a JOIN customer b ON abs(a.c_acctbal - b.c_acctbal) <= 0.5",
    "dbscan_labels": f"""WITH RECURSIVE {_POINTS}, {_LINKS.format(r='1.5625')},
        cores AS (SELECT u AS i FROM links GROUP BY u HAVING count(*) >= 4),
        steps AS (SELECT u, v FROM links WHERE u IN (SELECT i FROM cores) AND v IN (SELECT i FROM cores)),
        reach AS (SELECT u AS root, u AS v FROM steps UNION SELECT root, steps.v FROM reach JOIN steps ON reach.v = steps.u),
        core_root AS (SELECT v AS i, min(root) AS root FROM reach GROUP BY v),
        named AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS label FROM core_root),
        near AS (SELECT u AS i, v FROM links WHERE v IN (SELECT i FROM cores) QUALIFY row_number() OVER (PARTITION BY u ORDER BY d, v) = 1)
        SELECT p.i AS row_idx, coalesce(named.label, -1)::INT AS label FROM p LEFT JOIN near ON near.i = p.i LEFT JOIN named ON named.i = near.v""",
    "daura_neighbours": f"WITH {_POINTS}, {_LINKS.format(r='1')} SELECT u AS i, v AS j FROM links WHERE u <> v",
    "kmeans_1iter": f"{_lloyd(1)} SELECT k AS i, j, round(v, 6) + 0.0 AS v FROM c1",
    "kmeans_3iter": f"{_lloyd(3)} SELECT k AS i, j, round(v, 6) + 0.0 AS v FROM c3",
    "kmeans_assign": f"{_lloyd(4)} SELECT i AS row_idx, k::INT AS label FROM a3",
    "linreg_uni": "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS b0, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem",
    "linreg_two": f"""WITH s AS ({_SUMS}), b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b0, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b1 FROM s)
        SELECT round(b0, 3) AS b0, round(b1, 3) AS b1, round(ay - b0 * ax - b1 * az, 3) AS intercept FROM b""",
    "r2_score": "SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem",
    "accuracy_score": "SELECT round(avg(CASE WHEN label = 3 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM embeddings",
    "tree_best_split_gini": """WITH c AS (SELECT l_quantity AS x, l_returnflag AS c, count(*) AS k FROM lineitem GROUP BY ALL),
        t AS (SELECT l_returnflag AS c, count(*) AS t FROM lineitem GROUP BY ALL),
        g AS (SELECT xs.x, t.c, t.t, coalesce(c.k, 0) AS k FROM (SELECT DISTINCT x FROM c) xs CROSS JOIN t LEFT JOIN c ON c.x = xs.x AND c.c = t.c),
        l AS (SELECT x, t, sum(k) OVER (PARTITION BY c ORDER BY x)::DOUBLE AS l FROM g),
        s AS (SELECT x, sum(l) AS nl, sum(t - l) AS nr, sum(l * l) AS a, sum((t - l) * (t - l)) AS b FROM l GROUP BY x),
        n AS (SELECT *, lead(x) OVER (ORDER BY x) AS y FROM s)
        SELECT (x + y) / 2 AS threshold, round(-(a / nl + b / nr), 4) AS score FROM n WHERE nr > 0 ORDER BY -(a / nl + b / nr), threshold DESC LIMIT 1""",
    "tree_best_split_mse": """WITH c AS (SELECT l_quantity AS x, count(*) AS k, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL),
        l AS (SELECT x, sum(k) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS l, sum(k) OVER () AS n, sum(s) OVER () AS t, lead(x) OVER (ORDER BY x) AS y FROM c),
        r AS (SELECT (x + y) / 2 AS threshold, -(l * l / nl + (t - l) * (t - l) / (n - nl)) AS score FROM l WHERE n > nl)
        SELECT threshold, round(score, 0) AS score FROM r ORDER BY r.score, threshold DESC LIMIT 1""",
    "pca_components": f"WITH {_M} SELECT a.j AS i, b.j AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j",
    "pca_transform": f"WITH {_M} SELECT i, j, round(v - avg(v) OVER (PARTITION BY j), 6) + 0.0 AS v FROM m",
    "svd_product": f"WITH {_M} SELECT i, j, round(v, 6) + 0.0 AS v FROM m",
    "svd_u_gram": _IDENTITY,
    "qr_economic_q": f"WITH {_M} SELECT i, j, round(v, 6) + 0.0 AS v FROM m",
    "qr_q_gram": _IDENTITY,
    "tsqr_r": f"WITH {_M} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v, 0.0::DOUBLE AS below, 0::INT AS negative FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j",
    "svd_values": f"""WITH {_M}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) / (SELECT count(*) FROM embeddings) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j),
        gg AS (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY a.i, b.j)
        SELECT 1::INT AS power, round(sum(v), 8) AS trace FROM g WHERE i = j
        UNION ALL SELECT 2::INT, round(sum(v), 8) FROM gg WHERE i = j
        UNION ALL SELECT 3::INT, round(sum(a.v * b.v), 8) FROM gg a JOIN g b ON a.i = b.j AND a.j = b.i""",
    "random_svd": _VANISHED,
    "lanczos_svd": _VANISHED,
    "gmm_3iter": _em(3),
    "als_item_norms": """WITH r AS (SELECT DISTINCT c0, c1 FROM sample_movielens_ratings WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND c2 > 0)
        SELECT c1::BIGINT AS item, count(*) AS ratings, 0.0::DOUBLE AS residual FROM r GROUP BY c1""",
    "lasso_coefficients": "SELECT k::INT AS k, 0.0::DOUBLE AS gap FROM range(64) t(k)",
    "daura_clusters": f"""WITH RECURSIVE {_POINTS}, {_LINKS.format(r='1')}, l AS (SELECT u, v FROM links WHERE u <> v),
        steps AS (
          SELECT -1 AS cluster, NULL::BIGINT AS centre, []::BIGINT[] AS gone, []::BIGINT[] AS members
          UNION ALL
          SELECT s.cluster + 1, n.u, list_concat(s.gone, n.members), n.members
          FROM steps s, LATERAL (SELECT u, list_append(list(v ORDER BY v), u) AS members FROM l WHERE NOT list_contains(s.gone, u) AND NOT list_contains(s.gone, v)
                                 GROUP BY u ORDER BY count(*) DESC, u LIMIT 1) n)
        SELECT centre, unnest(members) AS member FROM steps WHERE centre IS NOT NULL""",
    "nearest_neighbors": f"""WITH {_E}, pairs AS (SELECT q.i AS q, f.i AS idx, {_D2} AS d2 FROM e q, e f),
        near AS (SELECT q, d2, row_number() OVER (PARTITION BY q ORDER BY round(d2, 12), idx) AS rank FROM pairs QUALIFY rank <= 3)
        SELECT q AS i, rank - 1 AS j, round(sqrt(d2), 6) + 0.0 AS v FROM near""",
    "grid_search_knn": f"""WITH {_E}, size AS (SELECT count(*) AS n FROM embeddings), half AS (SELECT (n + 1) // 2 AS h FROM size),
        pairs AS (SELECT q.i AS q, q.label AS truth, f.i AS idx, f.label, {_D2} AS d2, q.i >= h AS fold FROM e q, e f, half WHERE (q.i < h) <> (f.i < h)),
        near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d2, 12), idx) AS rank FROM pairs QUALIFY rank <= 5),
        votes AS (SELECT k, q, truth, fold, label, count(*) AS w, min(rank) AS first FROM near, (VALUES (1), (5)) t(k) WHERE rank <= k GROUP BY ALL),
        won AS (SELECT k, q, fold, label = truth AS hit FROM votes QUALIFY row_number() OVER (PARTITION BY k, q ORDER BY w DESC, first) = 1),
        folds AS (SELECT k, fold, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0 END) AS score FROM won GROUP BY k, fold),
        means AS (SELECT k, avg(score) AS score FROM folds GROUP BY k)
        SELECT k::INT AS n_neighbors, round(score, 6) AS mean_score, rank() OVER (ORDER BY score DESC)::INT AS rank FROM means""",
}
