import random

import pytest

from blockframe.llm import packing


def check(rows, sizes, capacity):
    """Every item whole, in pieces only beyond the capacity, no container over it."""
    fill, parts = {}, {}
    for r in rows:
        if r["container"] is None:
            assert r["size"] == 0
            continue
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        parts.setdefault(r["doc_id"], []).append(r)
    assert max(fill.values(), default=0) <= capacity
    for d, n in sizes.items():
        own = sorted(parts.get(d, []), key=lambda r: r["piece"])
        assert sum(r["size"] for r in own) == n
        assert len(own) == max(-(-n // capacity), 0)
        assert [r["start"] for r in own] == [k * capacity for k in range(len(own))]
        assert all(r["size"] == capacity for r in own[:-1])
    return fill


def items(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, n_tokens int, source string, cluster bigint")


@pytest.mark.parametrize("group_items", [50_000, 60])
def test_packs_tightly(spark, monkeypatch, group_items):
    monkeypatch.setattr(packing, "GROUP_ITEMS", group_items)
    r = random.Random(1)
    rows = [(i, r.choice([0, 1, r.randrange(100), r.randrange(1000), 100, 250]), r.choice(["a", "b", None]), r.randrange(200)) for i in range(600)]
    got = [x.asDict() for x in packing.pack_sizes(items(spark, rows), "doc_id", 100).collect()]
    fill = check(got, {i: n for i, n, _, _ in rows}, 100)
    total = sum(fill.values())
    assert len(fill) <= -(-total // 100) * 1.02 + 1


def test_conflicts_are_avoided_and_relaxed(spark):
    where, relaxed = packing.best_fit([6, 6, 4, 4], ["a", "b", "a", "b"], [1, 2, 3, 4], 10)
    assert where == [0, 1, 1, 0] and relaxed == [0, 0, 0, 0]
    where, relaxed = packing.best_fit([5, 5, 5, 5], ["a"] * 4, [1, 1, 2, 2], 10)
    assert len(set(where)) == 2 and relaxed.count(1) == 2  # sources are shared, equal texts kept apart
    where, relaxed = packing.best_fit([5, 5], ["a", "b"], [1, 1], 10)
    assert where == [0, 0] and relaxed == [0, 2]  # unused space counts first


def test_search_goes_on_to_the_tightest_compatible_bin():
    b = packing.Bins(10)
    assert b.add(7, 1, 0) == (0, 0)
    assert b.add(6, 2, 0) == (1, 0)
    assert b.add(5, 4, 0) == (2, 0)
    assert b.add(3, 1, 0) == (1, 0)  # the tightest bin has the source, the next is taken
    assert b.add(3, 8, 0) == (0, 0)


def test_defined_cases(spark):
    empty = packing.pack_sizes(items(spark, []), "doc_id")
    assert empty.count() == 0
    rows = [(1, 5, None, 1), (1, 5, None, 1), (2, 0, "a", 2), (3, 4096, "a", 3), (4, 4096 * 3 + 7, "a", 4)]
    got = packing.pack_sizes(items(spark, rows), "doc_id").collect()
    assert sum(r["size"] for r in got if r["doc_id"] == 1) == 10
    assert [r["container"] for r in got if r["doc_id"] == 2] == [None]
    assert sorted(r["size"] for r in got if r["doc_id"] == 4) == [7, 4096, 4096, 4096]
    assert len({r["container"] for r in got if r["size"] == 4096}) == 4
    with pytest.raises(ValueError):
        packing.pack_sizes(items(spark, rows), "doc_id", 0)


def test_texts(spark):
    rows = [(1, "one text", "s", 9), (2, None, None, 9), (3, "", "s", 9), (4, "one text", "s", 9), (5, "word " * 9000, "t", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, container int")
    got = [r.asDict() for r in packing.pack_texts(df).collect()]
    check(got, {1: 2, 2: 0, 3: 0, 4: 2, 5: 9001}, 4096)
