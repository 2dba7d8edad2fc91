"""Plans that must not depend on ids, order of rows, or one key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockframe import dsarray as A
from blockframe import linalg
from blockframe.cluster import Daura
from blockframe.functions.reductions import by_column
from blockframe.operators import ordering, proximity
from blockframe.operators.ingest import remainder, rejects
from blockframe.plans.balance import make_plan, route
from blockframe.recommendation import ALS


def rows(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "row_idx bigint, features array<double>")


@pytest.mark.parametrize("values", [proximity.BROADCAST_VALUES, 40])
def test_queries_of_any_id_come_out(spark, monkeypatch, values):
    monkeypatch.setattr(proximity, "BROADCAST_VALUES", values)
    r = np.random.default_rng(1)
    x, q = np.round(r.random((200, 2)), 1), np.round(r.random((9, 2)), 1)
    got = proximity.top_k(rows(spark, x, range(200)).repartition(5), rows(spark, q, range(5_000_000, 5_000_009)), 3, 2).collect()
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    want = {5_000_000 + i: np.lexsort((np.arange(200), np.round(d[i], 12)))[:3].tolist() for i in range(9)}
    found = {}
    for e in sorted(got, key=lambda e: e["rank"]):
        found.setdefault(e["q"], []).append(e["idx"])
    assert set(found) == set(want)
    for k, i in found.items():
        np.testing.assert_allclose(d[k - 5_000_000][i], d[k - 5_000_000][want[k]])


def test_top_k_sends_k_rows_a_partition(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        x = rows(spark, np.random.default_rng(2).random((100, 2)), range(100)).coalesce(1)
        assert proximity.top_k(x, x.limit(4), 3, 2).count() == 12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert proximity.top_k(x, x.limit(0), 3, 2).count() == 0 == proximity.top_k(x.limit(0), x, 3, 2).count()


def als(v, lam, d, start, passes):
    """Plain alternating least squares over a dict of ratings."""
    users, items = sorted({i for i, _ in v}), sorted({j for _, j in v})
    f = dict(start)
    for _ in range(passes):
        for side, own in (("u", users), ("i", items)):
            new = {}
            for k in own:
                mine = [(j if side == "u" else i, x) for (i, j), x in v.items() if (i if side == "u" else j) == k]
                m = np.array([f[o] if side == "u" else g[o] for o, _ in mine])
                new[k] = np.linalg.solve(m.T @ m + lam * len(mine) * np.eye(d), m.T @ np.array([x for _, x in mine]))
            if side == "u":
                g = new
            else:
                f = new
    return g, f


@pytest.mark.parametrize(("broadcast", "driver"), [(10**6, 10**6), (10**6, 0), (0, 0)])
def test_factors_with_hot_keys(spark, monkeypatch, broadcast, driver):
    from blockframe import recommendation

    monkeypatch.setattr(recommendation, "BROADCAST_VALUES", broadcast)
    monkeypatch.setattr(recommendation, "DRIVER_VALUES", driver)
    r = np.random.default_rng(3)
    v = {(int(i), int(j)): float(r.integers(1, 6)) for i in range(40) for j in range(25) if i == 3 or j == 7 or r.random() < 0.1}
    df = spark.createDataFrame([(i, j, x) for (i, j), x in v.items()], "i bigint, j bigint, v double").repartition(6)
    model = ALS(random_state=5, n_f=3, max_iter=2, check_convergence=False).fit(A.DsArray(df, (40, 25), True))
    start = {}
    for j in {j for _, j in v}:
        f = np.random.Generator(np.random.Philox(key=[5, j])).random(3)
        f[0] = np.mean([x for (_, k), x in v.items() if k == j])
        start[j] = f
    users, items = als(v, model.lambda_, 3, start, 2)
    for got, want in ((model._users, users), (model._items, items)):
        found = {e["id"]: e["f"] for e in got.collect()}
        assert set(found) == set(want)
        for k, f in want.items():
            np.testing.assert_allclose(found[k], f, rtol=1e-8)


def test_tiles_meet_by_output_tile(spark, monkeypatch):
    monkeypatch.setattr(linalg, "TILE", 4)
    r = np.random.default_rng(4)
    for n, k, m in ((9, 11, 6), (3, 2, 9), (12, 4, 4), (1, 1, 1)):
        x, y = r.random((n, k)), r.random((k, m))
        np.testing.assert_allclose(linalg.tile_matmul(A.array(x), A.array(y)).collect(squeeze=False), x @ y)


def test_routing_follows_from_values(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), "id")
    plan = make_plan(df, ["k"], tasks=8)
    assert plan.heavy
    one, other = ({e["id"]: e["__task"] for e in route(d, ["k"], plan).collect()} for d in (df, df.orderBy(F.desc("id")).repartition(3)))
    assert one == other and len(set(one.values())) == 8
    weighted = make_plan(df.groupBy("k").agg(F.count("id").alias("n")), ["k"], tasks=8, weight="n")
    assert {k: len(t) for k, t in weighted.heavy.items()} == {k: len(t) for k, t in plan.heavy.items()}


def test_only_the_remainder_is_diagnosed(spark):
    df = spark.createDataFrame([(1, "f", "1,2,3,1300000000"), (2, "f", "x")], "line_id bigint, file_name string, line string")
    plan = remainder(df)._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftAnti") :].split("Project", 2)[0]
    assert "transform" not in left
    done = rejects(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in done and "LogicalRDD" in done  # the diagnosis reads what was written out


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_medians(spark, n):
    r = np.random.default_rng(n)
    x = np.stack([r.normal(size=n), r.integers(0, 3, n), np.zeros(n), np.where(r.random(n) < 0.6, 1.5, r.random(n))], axis=1)
    np.testing.assert_allclose(by_column(A.array(x), "median").collect(squeeze=False)[0], np.median(x, axis=0))


def test_spreads_and_deletions(spark):
    x = np.random.default_rng(5).random((50, 3))
    a = A.array(x)
    np.testing.assert_allclose(A.apply_along_axis(np.std, 0, a).collect(), x.std(0))
    np.testing.assert_allclose(A.apply_along_axis(np.var, 0, a).collect(), x.var(0))
    gone = [49, 0, 7, 7, 30]
    np.testing.assert_array_equal(a.delete(i=gone).collect(), np.delete(x, gone, axis=0))
    assert a.delete(i=[]).shape == (50, 3)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_splits_are_numbered_densely(spark, monkeypatch, limit):
    monkeypatch.setattr(ordering, "WINDOW_ROWS", limit)
    x = np.arange(53.0).reshape(-1, 1)
    train, test = ordering.train_test_split(A.array(x), test_size=0.3, train_size=0.6, random_state=2, block_rows=10)
    a, b = train.collect(), test.collect()
    assert train.shape == (6 * 5 + 1, 1) and test.shape == (3 * 5, 1) and not set(a) & set(b)
    assert [int(v) // 10 for v in a] == sorted(int(v) // 10 for v in a) and len(set(a)) == len(a)


def test_clusters_by_rounds_are_those_taken_one_by_one(spark):
    r = np.random.default_rng(6)
    for cut in (0.05, 0.15, 0.4):
        x = np.round(r.random((60, 2)), 2)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        left, want = set(range(60)), []
        while True:
            near = {i: [j for j in left if j != i and d[i, j] <= cut] for i in left}
            top = max(left, key=lambda i: (len(near[i]), -i), default=None)
            if top is None or not near[top]:
                break
            want.append([top, *sorted(near[top])])
            left -= set(want[-1])
        assert Daura(cut).fit_predict(A.array(d)) == want


@pytest.mark.parametrize(("narrow", "values"), [(24, 4_000_000), (0, 4_000_000), (24, 60)])
def test_factors_of_few_users_with_large_ids_are_broadcast(spark, monkeypatch, narrow, values):
    from blockframe import recommendation

    def refused(*a, **k):
        raise AssertionError("40 users need no join")

    monkeypatch.setattr(recommendation, "fragment_replicate_join", refused)
    monkeypatch.setattr(recommendation, "NARROW", narrow)
    monkeypatch.setattr(recommendation, "SLICE_VALUES", values)
    r = np.random.default_rng(8)
    v = {(1_000_003 * i, j): float(r.integers(1, 6)) for i in range(40) for j in range(25) if i == 3 or j == 7 or r.random() < 0.2}
    x = A.DsArray(spark.createDataFrame([(i, j, x) for (i, j), x in v.items()], "i bigint, j bigint, v double"), (40_000_000, 25), True)
    model = ALS(random_state=5, n_f=3, max_iter=2, check_convergence=False).fit(x)
    users, items = ({e["id"]: np.array(e["f"]) for e in f.collect()} for f in (model._users, model._items))
    assert set(users) == {i for i, _ in v}
    for j, f in items.items():
        mine = [(users[i], x) for (i, k), x in v.items() if k == j]
        m, b = np.array([u for u, _ in mine]), np.array([x for _, x in mine])
        np.testing.assert_allclose(m.T @ (b - m @ f), model.lambda_ * len(b) * f, atol=1e-9)
    assert model.rmse_ == pytest.approx(np.sqrt(np.mean([(x - users[i] @ items[j]) ** 2 for (i, j), x in v.items()])))


def test_distances_leave_a_task_in_pieces(spark, monkeypatch):
    def small(q, y):
        assert len(q) * len(y) <= 900
        return ((q[:, None] - y[None]) ** 2).sum(axis=2)

    monkeypatch.setattr(proximity, "CHUNK", 900)
    monkeypatch.setattr(proximity, "squared", small)
    x = np.random.default_rng(10).random((90, 2))
    a = A.DsArray(rows(spark, x, range(90)).coalesce(1), (90, 2))
    np.testing.assert_allclose(proximity.pairwise_distances(a, a).collect(), np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))


@pytest.mark.parametrize("driver", [8_000_000, 0])
def test_clusters_need_no_matrix_of_distances(spark, monkeypatch, driver):
    from blockframe.cluster import daura

    monkeypatch.setattr(daura, "DRIVER_VALUES", driver)
    monkeypatch.setattr(proximity, "BROADCAST_VALUES", 50)
    x = np.round(np.random.default_rng(9).random((70, 2)) * 3, 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    model, points = Daura(0.5), A.array(x)
    links = model.near(points)
    assert sorted((r["i"], r["j"]) for r in links.collect()) == [(i, j) for i in range(70) for j in range(70) if i != j and d[i, j] <= 0.5]
    found = {}
    for r in model.clusters_of(links, 70).collect():
        found.setdefault((-r["size"], r["centre"]), []).append(r["member"])
    assert [[k[1], *sorted(v)] for k, v in sorted(found.items())] == model.fit_predict(A.array(d))


@pytest.mark.parametrize(("strip", "broadcast"), [(512, 4_000_000), (7, 400), (1, 120)])
def test_sparse_products_make_no_row_of_each_product(spark, monkeypatch, strip, broadcast):
    monkeypatch.setattr(linalg, "STRIP", strip)
    monkeypatch.setattr(linalg, "BROADCAST_VALUES", broadcast)
    r = np.random.default_rng(11)
    x, y = (np.where(r.random(s) < 0.3, np.round(r.normal(size=s), 2), 0) for s in ((40, 30), (30, 50)))
    x[:, 3] = y[3, ::2] = 0
    x[5, :2], y[0, 7], y[1, 7] = (1, -1), 2, 2
    x[5, 2:] = y[2:, 7] = 0  # they meet and cancel out
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        a, b = (A.array(z).to_sparse() for z in (x, y))
        out = linalg.matmul(a, b)
        assert "Join" not in out.df._jdf.queryExecution().optimizedPlan().toString()
        got = {(e["i"], e["j"]): e["v"] for e in out.df.collect()}
        assert out.df.count() == len(got) and set(got) == set(zip(*map(list, np.nonzero((x != 0) * 1.0 @ (y != 0))), strict=True)) and got[5, 7] == 0
        for (i, j), v in got.items():
            assert v == pytest.approx((x @ y)[i, j], abs=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    y[4, 4] = np.inf
    odd = linalg.matmul(a, A.array(y).to_sparse()).df.filter("j <> 4 AND isnan(v)")
    assert odd.isEmpty()
