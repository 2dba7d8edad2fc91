import random

import numpy as np
import pytest

from blockframe.llm import proportions as P

M = ["m1", "m2"]
ROWS = "row_idx bigint, block_id int, class int, m1 double, m2 double"
TARGETS = "block_id int, class int, sample_size int, target_share double, min_rows int"


def test_newton_meets_moments():
    r = np.random.default_rng(1)
    for _ in range(20):
        k = r.integers(1, 9)
        n = r.integers(1, 5000, k).astype(float)
        target = n * r.uniform(1e-4, 0.999, k)
        p = P.newton_dual(np.eye(k), n, target, float(r.uniform(1e-4, 1)))
        np.testing.assert_allclose(n * p, target, rtol=1e-6)
    x = np.array([[1, 0, 1], [1, 0, 0], [0, 1, 1], [0, 1, 0.0]])  # overlapping categories
    n = np.array([100, 200, 300, 400.0])
    target = x.T @ (n * [0.1, 0.2, 0.3, 0.05])
    np.testing.assert_allclose(x.T @ (n * P.newton_dual(x, n, target, 0.2)), target, rtol=1e-6)


def test_tilting_meets_categories_and_nears_bins():
    r = np.random.default_rng(4)
    for _ in range(30):
        k, b = int(r.integers(1, 7)), int(r.integers(1, 9))
        category, bins = np.repeat(np.arange(k), b), np.tile(np.arange(b), k)
        n = r.integers(0, 400, k * b) * (r.random(k * b) < 0.8)
        supply = np.bincount(category, n, k)
        target = {c: float(min(supply[c], r.integers(0, 300))) for c in range(k)}
        p = P.tilt(category, bins, n, target)
        assert p.min() >= 0 and p.max() <= 1 + 1e-9
        np.testing.assert_allclose(np.bincount(category, n * p, k), [target[c] for c in range(k)], atol=1e-6)
    #: Two categories of opposite measures: the sample takes more of the rarer bin of each, so that its bins come nearer to the block's.
    category, bins, n = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([900, 100, 10, 90])
    p = P.tilt(category, bins, n, {0: 50.0, 1: 50.0})
    drawn, plain = np.bincount(bins, n * p), np.bincount(bins, n * np.array([0.05, 0.05, 0.5, 0.5]))
    want = np.bincount(bins, n) / n.sum() * 100
    assert abs(drawn - want).max() < 0.8 * abs(plain - want).max() and p[0] > p[1] and p[2] > p[3]


def test_pivotal():
    r = np.random.default_rng(2)
    p = np.array([0.3] * 10 + [0.8] * 5)
    hits = np.zeros(15)
    for _ in range(3000):
        q = P.pivotal(p, r)
        assert set(q) <= {0.0, 1.0} and q.sum() == 7
        hits += q
    np.testing.assert_allclose(hits / 3000, p, atol=0.04)
    q = P.pivotal(np.array([0.5, 0.25, 0.5]), r)
    assert ((q > 0) & (q < 1)).sum() == 1 and q.sum() == pytest.approx(1.25)


@pytest.mark.parametrize("shard", [50_000, 40])
def test_sample(spark, monkeypatch, shard):
    monkeypatch.setattr(P, "SHARD", shard)
    r = random.Random(3)
    rows, i = [], 0
    for block in range(3):
        for c, n in ((0, 300), (1, 60), (2, 5), (None, 10)):
            for _ in range(n):
                rows.append((i, block, c, r.random() + 0.1, r.choice([1.0, None, float("nan"), -1.0, 2.0, 3.0])))
                i += 1
    rows += [(i + k, 0, 2, 7.0, 7.0) for k in range(50)] + [(i + 60, None, 0, 1.0, 1.0)]
    usable = {}
    for row in rows:
        if row[1] is not None and row[2] is not None and row[4] is not None and row[4] == row[4] and row[4] > 0:
            usable.setdefault((row[1], row[2]), {}).setdefault(row[3:], row[0])
    targets = [(b, c, 100, s, m) for b in range(3) for c, s, m in ((0, 0.8, 0), (1, 0.15, 20), (2, 0.05, 5), (9, 0.0, 1))] + [(7, 0, 10, 1.0, 0)]
    units = P.distinct_units(spark.createDataFrame(rows, ROWS), "row_idx", "block_id", "class", M)
    cells = P.calibrate(units, spark.createDataFrame([(*t, "x") for t in targets], TARGETS + ", p string"), "block_id", "class")
    want = {(b, c): max(m, int(s * n + 0.5)) for b, c, n, s, m in targets}
    report = {(x.block_id, x["class"]): x for x in P.report(cells, "block_id", "class").collect()}
    assert set(report) == set(want)
    for key, x in report.items():
        supply = len(usable.get(key, {}))
        assert (x.need, x.supply, x.gap, x.expected) == (want[key], supply, max(0, want[key] - supply), min(want[key], supply))
    drawn = P.draw(units, cells, "row_idx", "block_id", "class").collect()
    count = {}
    for x in drawn:
        key = (x.block_id, x["class"])
        assert x.row_idx in usable[key].values()
        count[key] = count.get(key, 0) + 1
    assert len({x.row_idx for x in drawn}) == len(drawn)
    assert count == {k: x.expected for k, x in report.items() if x.expected}


def test_empty(spark):
    rows, targets = spark.createDataFrame([], ROWS), spark.createDataFrame([], TARGETS)
    units = P.distinct_units(rows, "row_idx", "block_id", "class", M)
    cells = P.calibrate(units, targets, "block_id", "class")
    assert cells.count() == 0 and P.draw(units, cells, "row_idx", "block_id", "class").count() == 0
