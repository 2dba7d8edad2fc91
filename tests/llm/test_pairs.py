import random
from collections import Counter
from itertools import combinations

import pytest

from blockframe.llm import pairs


def brute(rows):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = len(baskets)
    single = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    out = {}
    for (a, b), k in both.items():
        conviction = None if k == single[a] else (1 - single[b] / n) / (1 - k / single[a])
        out[a, b] = (k, single[a], single[b], n, round(k * n / (single[a] * single[b]), 9), None if conviction is None else round(conviction, 9))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(b, i, "x") for b, i in rows], "c0 int, c1 int, item string")
    got = pairs.co_occurrence(df, "c0", "c1", **options).collect()
    return {(r.item_a, r.item_b): (r.common, r.support_a, r.support_b, r.n_baskets, round(r.lift, 9), None if r.conviction is None else round(r.conviction, 9)) for r in got}


@pytest.mark.parametrize("block", [2048, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "HELD", 20)
    monkeypatch.setattr(pairs, "CHUNK", 50)
    r = random.Random(1)
    rows = [(1 if r.random() < 0.3 else r.choice([*range(40), None]), r.choice([*range(-3, 15), None])) for _ in range(900)] + [(99, 1)]
    assert found(spark, rows) == brute(rows)
    want = {k: v for k, v in brute(rows).items() if v[0] >= 9 and v[0] >= 0.25 * v[3]}
    assert found(spark, rows, min_common=9, min_share=0.25) == want


def test_large_basket_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 300)
    rows = [(1, i) for i in range(700)]
    got = found(spark, rows)
    assert len(got) == 700 * 699 // 2 and {v[0] for v in got.values()} == {1}


def test_defined_cases(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, 1), (1, None), (None, None)]) == {}
    assert found(spark, [(1, 5), (2, 5), (2, 5)]) == {}
    assert found(spark, [(1, 5), (1, 6), (1, 5)])[5, 6] == (1, 1, 1, 1, 1.0, None)
