"""Items that occur together, with how much more often than by chance (problem 5).

Basket collapsing: the distinct items of each basket form a sorted array; identical arrays become one array with a weight;
pairs are enumerated once per distinct array, in Arrow batches, where the weights of equal pairs are summed before anything
is shuffled. An array of over ``BLOCK`` items is cut into ranges of first items, spread over tasks, so that no task enumerates
a large basket alone. Items whose support cannot reach the wanted number of common baskets are left out first, which is
exact, and lets more baskets collapse.

Defined cases: null baskets and null items are ignored; an item counts once in a basket; a basket of one item counts in the
number of baskets; an empty table gives an empty result; other columns, whatever their names, are unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.plans.runtime import durable, shuffle_tasks

BLOCK = 2048
#: Pairs held in a Python worker before they are summed up, and sums held before they are sent on.
CHUNK, HELD = 2_000_000, 1_000_000


class Sums:
    """Weights of pair codes, summed."""

    def __init__(self):
        self.codes, self.weights, self.n = [], [], 0
        self.code, self.weight = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, codes: np.ndarray, weight: int) -> None:
        self.codes.append(codes)
        self.weights.append((weight, len(codes)))
        self.n += len(codes)
        if self.n >= CHUNK:
            self.fold()

    def fold(self) -> None:
        if self.codes:
            w = np.repeat(*(np.array(x, np.int64) for x in zip(*self.weights, strict=True)))
            codes, weights = np.concatenate([self.code, *self.codes]), np.concatenate([self.weight, w])
            order = np.argsort(codes, kind="stable")
            codes, weights = codes[order], weights[order]
            begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            self.code, self.weight = codes[begin], np.add.reduceat(weights, begin)
            self.codes, self.weights, self.n = [], [], 0

    def take(self) -> pa.RecordBatch:
        self.fold()
        a, b = (self.code >> 32).astype(np.int32), (self.code & 0xFFFFFFFF).astype(np.uint32).astype(np.int32)
        out = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(self.weight)], ["item_a", "item_b", "common"])
        self.__init__()
        return out


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, triangles = Sums(), {}
    for batch in batches:
        offsets, values = np.asarray(batch.column(0).offsets), np.asarray(batch.column(0).values).astype(np.int64)
        for k, (weight, begin, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
            items = values[offsets[k] : offsets[k + 1]]
            low, m = items & 0xFFFFFFFF, len(items)
            if m <= 256 and end - begin >= m:
                if m not in triangles:
                    triangles[m] = np.triu_indices(m, 1)
                i, j = triangles[m]
                sums.add((items[i] << 32) | low[j], weight)
            else:
                for i in range(begin, min(end, m - 1)):
                    sums.add((items[i] << 32) | low[i + 1 :], weight)
            if len(sums.code) >= HELD:
                yield sums.take()
    yield sums.take()


def baskets_of(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct (basket, item INT) without nulls."""
    return df.select(F.col(basket).alias("basket"), F.col(item).cast("int").alias("item")).dropna().distinct()


def collapse(members: DataFrame) -> DataFrame:
    """(items, weight): each distinct sorted item array of at least two items, with its number of baskets."""
    arrays = members.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return arrays.filter(F.size("items") > 1).groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def pair_counts(collapsed: DataFrame) -> DataFrame:
    """(item_a, item_b, common) with item_a < item_b over collapsed baskets."""
    begins = F.when(F.size("items") > BLOCK, F.sequence(F.lit(0), F.size("items") - 1, F.lit(BLOCK))).otherwise(F.array(F.lit(0)))
    spread = collapsed.select("items", "weight", F.explode(begins).alias("begin"))
    spread = spread.withColumn("end", F.least(F.col("begin") + BLOCK, F.size("items"))).repartition(shuffle_tasks(collapsed.sparkSession))
    sums = spread.mapInArrow(_enumerate, "item_a int, item_b int, common bigint")
    return sums.groupBy("item_a", "item_b").agg(F.sum("common").alias("common"))


def co_occurrence(df: DataFrame, basket: str, item: str, min_common: int = 1, min_share: float = 0.0) -> DataFrame:
    """Pairs of items with at least ``min_common`` common baskets and that share of all baskets.

    Columns: item_a, item_b (item_a < item_b), common, support_a, support_b, n_baskets, lift (common against the number expected by
    chance), conviction (of item_b given item_a; null where every basket of item_a has item_b).
    """
    members = durable(baskets_of(df, basket, item))
    n = members.agg(F.countDistinct("basket")).first()[0]
    least = max(min_common, -(-round(min_share * 1_000_000) * n // 1_000_000))
    support = members.groupBy("item").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    kept = members if least <= 1 else members.join(support.select("item"), "item", "left_semi")
    counts = pair_counts(collapse(kept)).filter(F.col("common") >= least)
    a, b = (support.select(F.col("item").alias(f"item_{x}"), F.col("support").alias(f"support_{x}")) for x in "ab")
    out = counts.join(a, "item_a").join(b, "item_b").withColumn("n_baskets", F.lit(n).cast("bigint"))
    return out.select(
        "item_a",
        "item_b",
        "common",
        "support_a",
        "support_b",
        "n_baskets",
        (F.col("common") * F.col("n_baskets") / (F.col("support_a") * F.col("support_b"))).alias("lift"),
        F.when(
            F.col("common") < F.col("support_a"),
            (1 - F.col("support_b") / F.col("n_baskets")) / (1 - F.col("common") / F.col("support_a")),
        ).alias("conviction"),
    )
