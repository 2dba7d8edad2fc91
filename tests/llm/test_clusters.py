import numpy as np
import pytest

from blockframe.llm import clusters as C

COLUMNS = ["a", "b", "c"]
SCHEMA = "row_idx bigint, a double, b double, c double, x string, n int, vid string, cluster string"


def table(spark, x):
    return spark.createDataFrame([(i, *(None if v is None else float(v) for v in r), "x", 1, "y", "z") for i, r in enumerate(x)], SCHEMA)


def brute(x, eps, least=3):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    label = np.arange(len(x))
    for i in range(len(x)):
        stack = [i] if label[i] == i else []
        while stack:
            for j in np.flatnonzero((d[stack.pop()] <= (eps + C.SLACK) ** 2) & (label != i)):
                if label[j] == j and j > i:
                    label[j] = i
                    stack.append(j)
    return {(int(label[i]), i) for i in range(len(x)) if (label == label[i]).sum() >= least}


@pytest.mark.parametrize(("leaves", "cap"), [(4096, 20_000), (8, 20_000), (8, 30)])
def test_linked_equals_brute_force(spark, leaves, cap):
    r = np.random.default_rng(1)
    chain = np.stack([2 + np.arange(200) * 0.019, np.full(200, 3.0), np.full(200, 1.0)], axis=1)
    x = np.vstack([r.uniform(1, 2, (300, 3)), chain[r.permutation(200)], np.tile([[5.0, 5, 5]], (40, 1)), r.normal(7, 0.01, (80, 3)), [[9, 9, 9], [9.02, 9, 9], [9.04, 9, 9], [9, 9.020001, 9]]])
    x = x[r.permutation(len(x))].round(6)
    got = {(v.cluster_row, v.row_idx) for v in C.linked(table(spark, x), "row_idx", COLUMNS, 0.02, 3, leaves, cap).collect()}
    assert got == brute(x, 0.02)


def test_defined_cases(spark):
    x = [[None, 1, 1], [1, 1, 1], [float("nan"), 1, 1], [1, 1, 1], [0, 1, 1], [1, 1, 1], [3, 3, 3]]
    assert {(v.cluster_row, v.row_idx) for v in C.linked(table(spark, x), "row_idx", COLUMNS, 0.02).collect()} == {(1, 1), (1, 3), (1, 5)}
    assert C.linked(table(spark, []), "row_idx", COLUMNS, 0.02).count() == 0
    assigned, _ = C.cluster(table(spark, []), "row_idx", COLUMNS, 3, 0.1)
    assert C.describe(assigned, "row_idx").count() == 0


def test_clusters_are_described(spark):
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(c, 0.1, (n, 3)) for c, n in ((2, 60), (5, 30), (8, 10))])
    assigned, centroids = C.cluster(table(spark, x), "row_idx", COLUMNS, 3, 0.05)
    np.testing.assert_allclose(centroids, [x[:60].mean(0), x[60:90].mean(0), x[90:].mean(0)], atol=1e-6)
    rows = C.describe(assigned, "row_idx", 2).collect()
    assert sorted({(v.cluster, v.size) for v in rows}) == [(0, 60), (1, 30), (2, 10)]
    d = np.linalg.norm(x[:60] - centroids[0], axis=1)
    assert [v.row_idx for v in sorted(rows, key=lambda v: (v.cluster, v["rank"]))][:2] == np.argsort(d)[:2].tolist()


def test_trees_keep_sums_and_radius():
    r = np.random.default_rng(3)
    x = r.uniform(0, 1, (3000, 2))
    tree = C.CFTree(2, 0.05, leaves=200)
    for part in np.array_split(x, 7):
        tree.add(np.ones(len(part)), part, (part**2).sum(1))
    n, s, ss = tree.entries()
    assert len(n) == tree.size <= 200 and n.sum() == 3000
    np.testing.assert_allclose(s.sum(0), x.sum(0))
    radius2 = ss / n - ((s / n[:, None]) ** 2).sum(1)
    assert radius2.max() <= tree.threshold**2 + 1e-9
    total, where = tree.root.total(), [tree.root]
    while where:
        node = where.pop()
        for i, child in enumerate(node.children or []):
            np.testing.assert_allclose(child.total()[0], node.n[i])
            np.testing.assert_allclose(child.total()[1], node.s[i])
            where.append(child)
    assert total[0] == 3000


def test_ward_equals_plain_agglomeration():
    r = np.random.default_rng(4)
    c, n = r.normal(size=(40, 2)), r.integers(1, 9, 40).astype(float)
    groups = [([i], n[i], c[i]) for i in range(40)]
    while len(groups) > 5:
        cost, i, j = min((a[1] * b[1] / (a[1] + b[1]) * ((a[2] - b[2]) ** 2).sum(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        a, b = groups[i], groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [(a[0] + b[0], a[1] + b[1], (a[1] * a[2] + b[1] * b[2]) / (a[1] + b[1]))]
    label = C.ward(n, c, 5)
    assert {frozenset(g[0]) for g in groups} == {frozenset(np.flatnonzero(label == k).tolist()) for k in range(5)}
