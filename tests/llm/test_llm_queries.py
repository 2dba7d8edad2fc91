import sys
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parents[1])]

from blockframe.llm.packing import CAPACITY  # noqa: E402
from blockframe.llm.queries import ORACLES, QUERIES  # noqa: E402
from oracle import actual, expected  # noqa: E402


def _documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def _sample(rows, sf):
    """block_id, class, p, row_idx: no row twice, probabilities of drawn rows above 0; p3_counts has the numbers of rows."""
    assert rows and len({r[3] for r in rows}) == len(rows) and all(0 < r[2] <= 1 for r in rows)


def _clusters(rows, sf):
    """cluster, distance, rank, row_idx, size."""
    by = {}
    for cluster, distance, rank, row, size in rows:
        by.setdefault(cluster, []).append((rank, distance, row, size))
    assert len(by) == 9
    for found in by.values():
        ranks, distances, ids, sizes = zip(*sorted(found), strict=True)
        assert ranks == tuple(range(1, len(ranks) + 1)) and list(distances) == sorted(distances)
        assert len(set(ids)) == len(ids) and len(set(sizes)) == 1 and sizes[0] >= len(ids)


def _ids(rows, sf):
    """doc_id, ids; p7_text has what they stand for."""
    texts = {d["doc_id"]: d["text"] for d in _documents(sf)}
    assert {r[0] for r in rows} == set(texts) and all(bool(ids) == bool(texts[doc]) for doc, ids in rows)


def _containers(rows, sf):
    """container, doc_id, piece, relaxed, size, start, unused."""
    used = Counter()
    for container, _, _, _, size, _, _ in rows:
        if container is not None:
            used[container] += size
    assert max(used.values()) <= CAPACITY and all(r[6] == CAPACITY - used[r[0]] for r in rows if r[0] is not None)
    assert sum(used.values()) / (len(used) * CAPACITY) > 0.9


def _report(rows, sf):
    """cluster_shared, containers, source_shared, tokens, unused_share."""
    ((_, containers, _, tokens, unused),) = rows
    assert unused == pytest.approx(1 - tokens / (containers * CAPACITY), abs=1e-6) and 0 <= unused < 0.1


def _found(rows, sf):
    known = {d["doc_id"] for d in _documents(sf) if (d["text"] or "").strip()}
    assert len(set(rows)) == len(rows) and {r[0] for r in rows} <= known


def _scores(rows, sf):
    """abusive, doc_id, evidence, score, source."""
    texts = {d["doc_id"]: d["text"] for d in _documents(sf)}
    assert Counter(r[1] for r in rows) == Counter(list(texts))
    for abusive, doc, evidence, score, _ in rows:
        assert score >= 0 and (not abusive or evidence) and ((texts[doc] or "").strip() or score == 0)
    flagged, rest = ([r[3] for r in rows if r[0] == flag] for flag in (True, False))
    assert min(flagged, default=99) > max(rest)


def _rates(rows, sf):
    """abusive, documents, rate, source."""
    assert Counter({r[3]: r[1] for r in rows}) == Counter(d["source"] for d in _documents(sf))
    assert all(0 <= a <= n and rate == pytest.approx(a / n, abs=1e-6) for a, n, rate, _ in rows)


CHECKS = {
    "p3_sample": _sample, "p6_clusters": _clusters, "p7_ids": _ids, "p8_containers": _containers, "p8_report": _report,
    "p9_found": _found, "p9_scores": _scores, "p9_rates": _rates,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = actual(QUERIES[name](spark, sf))
    if name in ORACLES:
        assert got == expected(sf, ORACLES[name])
    else:
        CHECKS[name](got[1], sf)


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES) | set(CHECKS)
