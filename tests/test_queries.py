"""Every registered query with SQL gives the same rows as DuckDB; the others are held to what is known of their results."""

import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import __spark_entry__ as entry  # noqa: E402
from blockframe import queries as core  # noqa: E402
from blockframe.queries.estimators import START  # noqa: E402
from oracle import actual, expected  # noqa: E402


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, name):
    got = actual(core.QUERIES[name](spark, sf))
    if name in core.ORACLES:
        assert got == expected(sf, core.ORACLES[name])
    else:
        CHECKS[name](got[1], sf)


def _vectors(sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").sort_by("vec_id")
    return np.array(t["embedding"].to_pylist(), float), np.array(t["label"].to_pylist(), float)


def _labels(least):
    """Rows (label, row_idx) of a model that was trained on them: one of each row, and right more often than ``least``."""

    def check(rows, sf):
        _, y = _vectors(sf)
        found = {int(i): float(label) for label, i in rows}
        assert len(rows) == len(y) and set(found) == set(range(len(y))) and set(found.values()) <= set(y)
        assert np.mean([found[i] == y[i] for i in found]) >= least

    return check


def _regressed(rows, sf):
    _, y = _vectors(sf)
    found = np.array([label for label, _ in sorted(rows, key=lambda r: r[1])])
    assert len(found) == len(y) and ((found - y) ** 2).mean() < 0.8 * y.var() and y.min() <= found.min() and found.max() <= y.max()


def _mixture(rows, sf):
    """The fixed point of plain expectation maximisation from the same start."""
    t = pq.read_table(f"{sf}/supplier.parquet").sort_by("s_suppkey")
    x = np.stack([np.array(t["s_acctbal"].to_pylist(), float) / 1000, np.array(t["s_nationkey"].to_pylist(), float)], axis=1)
    w, mu, cov, last = np.array([0.3, 0.3, 0.4]), np.array(START), np.stack([np.eye(2) * 9] * 3), -np.inf
    for _ in range(100):
        d = x[None] - mu[:, None]
        logs = np.log(w)[:, None] - 0.5 * (np.einsum("kni,kij,knj->kn", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov))[:, None] + 2 * np.log(2 * np.pi))
        norm = np.logaddexp.reduce(logs, axis=0)
        r = np.exp(logs - norm)
        n = r.sum(axis=1)
        w, mu = n / len(x), (r @ x) / n[:, None]
        d = x[None] - mu[:, None]
        cov = np.einsum("kn,kni,knj->kij", r, d, d) / n[:, None, None] + 1e-6 * np.eye(2)
        if abs(norm.mean() - last) < 1e-3:
            break
        last = norm.mean()
    for k, weight, a, b in rows:
        np.testing.assert_allclose([weight, a, b], [w[k], *mu[k]], rtol=1e-4)


#: The labels of embeddings are noise: a model only has to do no worse than chance on them. Quality is tested on separable data.
CHECKS = {
    "csvm_labels": _labels(0.08),
    "nn_labels": _labels(0.12),
    "rf_classifier": _labels(0.3),
    "dt_classifier": _labels(0.3),
    "rf_regressor": _regressed,
    "gmm_full": _mixture,
}


def test_every_query_is_checked():
    assert set(core.QUERIES) == set(core.ORACLES) | set(CHECKS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert [n for n in entry.queries() if n.startswith("p")]
