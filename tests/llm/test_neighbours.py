import numpy as np
import pytest

from blockframe.llm import neighbours as N

COLUMNS = ["a", "b", "c"]
SCHEMA = "row_idx bigint, a double, b double, c double, x string, id int, near string"


def table(spark, x, ids=None):
    rows = [(int(i), *(None if v is None else float(v) for v in r), "x", 1, "y") for i, r in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(x, ids, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    out = {}
    for r in range(len(x)):
        order = [j for j in np.lexsort((ids, d[r])) if j != r][:k]
        out[int(ids[r])] = [(int(ids[j]), round(float(np.sqrt(d[r, j])), 9)) for j in order]
    return out


def found(df, k):
    return {r.row_idx: [(e.id, round(e.d**0.5, 9)) for e in r.near] for r in N.nearest(df, "row_idx", COLUMNS, k).collect()}


@pytest.mark.parametrize("cap", [4096, 20])
def test_equals_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(N, "LIST_CAP", cap)
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(3, 0.5, (300, 3)), r.uniform(0.1, 60, (30, 3)), np.full((120, 3), 2.5), r.normal(5, 0.01, (150, 3)), np.round(r.uniform(1, 3, (100, 3)))]).clip(0.01)
    ids = r.permutation(5 * len(x))[: len(x)]
    assert found(table(spark, x, ids), 5) == brute(x, ids, 5)


def recall(index, want, k):
    """Share of the ids in ``want`` that the lists alone find."""
    got = {r.vid: [e.id for e in r.near] for r in index.search(check=False).collect()}
    hits = sum(len(set([i for i in got[v] if i != v][:k]) & {i for i, _ in near}) for v, near in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_before_the_exact_check(spark):
    """The lists of the distance ratio alone reach a recall of 0.9; the check adds the rest."""
    x = np.random.default_rng(2).normal(5, 1, (4000, 3)).clip(0.01)
    vectors = N.durable(N.distinct_vectors(table(spark, x), "row_idx", COLUMNS, 6))
    assert recall(N.Index(vectors, 5, list_size=64), brute(x, np.arange(len(x)), 5), 5) >= 0.9


def test_recall_on_flowers(spark, sf):
    """The same on the four measures of iris_csv, with lists small enough that there are many."""
    from blockframe.llm.queries import MEASURES

    flowers = spark.read.parquet(f"{sf}/iris_csv.parquet")
    vectors = N.durable(N.distinct_vectors(flowers, "row_idx", MEASURES, 6))
    rows = vectors.collect()
    x, vid = np.array([r.x for r in rows]), np.array([r.vid for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {int(v): [(int(vid[j]), 0) for j in np.lexsort((vid, d[r])) if j != r][:5] for r, v in enumerate(vid)}
    single = {r.vid for r in rows if len(r.ids) == 1}
    near = {v: n for v, n in want.items() if v in single and all(i in single for i, _ in n)}
    assert recall(N.Index(vectors, 5, list_size=16), near, 5) >= 0.9


def test_graph_search_and_balance():
    x = np.random.default_rng(3).normal(size=(5000, 4))
    parts = N.split_balanced(x, 40)
    assert sorted(np.concatenate(parts).tolist()) == list(range(5000)) and max(map(len, parts)) <= 1.1 * min(map(len, parts))
    g = N.CentroidGraph(np.array([x[p].mean(axis=0) for p in N.split_balanced(x, 500)]))
    q = x[:400]
    ids, _ = g.search(q, 3)
    exact = N.distances(q, g.c).argmin(axis=1)
    assert (ids[:, 0] == exact).mean() > 0.97


def test_defined_cases(spark):
    assert found(table(spark, []), 5) == {}
    x = [[1, 1, 1], [None, 1, 1], [float("nan"), 1, 1], [0, 1, 1], [-1, 2, 2]]
    assert found(table(spark, x), 5) == {0: []}
    same = np.ones((9, 3))
    assert found(table(spark, same), 5) == brute(same, np.arange(9), 5)
    assert found(table(spark, np.array([[1, 1, 1], [1, 1, 2.0]])), 5) == {0: [(1, 1.0)], 1: [(0, 1.0)]}
