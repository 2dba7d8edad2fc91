"""Filling fixed-capacity containers with texts measured in tokens (problem 8).

Conflict-constrained best fit: items are taken largest first; the open bins are ordered by what is left in them, and each
bin carries two bitmaps, of the sources and of the duplicate clusters (equal texts) it holds. The successor search starts
at the tightest bin that has room and goes on until the tightest *compatible* bin is found. Where none is, a new bin is opened as
long as fewer are open than all items need at least. Beyond, unused space counts first: the tightest bin free of the item's
cluster is taken, then the tightest bin, before one more is opened.

Only an item beyond the capacity is split: into pieces of exactly the capacity, which fill a container each, and a rest
that is packed like any item. Packing runs in groups of items drawn by hash, sized so that a group's last, partly filled
bins are a negligible part; the items of bins left with more than ``1 / LOOSE`` of unused space go through a second round,
in fewer groups. No group grows with the data.

Defined cases: null and empty texts take no space and come out with a null container; a null source is a source of its own
and constrains like any other; repeated rows are items each; ties in size go by id; an empty table gives an empty result;
other columns, whatever their names, are unused.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.llm import bpe
from blockframe.plans.index import dense_index
from blockframe.plans.runtime import durable

CAPACITY = 4096
#: Containers and items that one group holds about.
GROUP_CONTAINERS, GROUP_ITEMS = 4096, 50_000
#: Bins with over 1 / LOOSE of their capacity unused are packed again.
LOOSE = 64
_ROW = "__id {kind}, piece int, start int, size int, __source bigint, __cluster bigint"


class Bins:
    """Open bins in the order of their residuals, with bitmaps of what they hold."""

    def __init__(self, capacity: int, least: int = 0):
        self.capacity, self.least = capacity, least
        self.residuals: list[int] = []  # distinct residuals that have bins, ascending
        self.at: dict[int, list[int]] = {}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _search(self, size: int, source: int, cluster: int) -> tuple[int, int, int] | None:
        """(residual, place in its list, degree of relaxation) of the bin to take."""
        free_of_cluster = any_bin = None
        for k in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[k]
            for place, b in enumerate(self.at[residual]):
                if not self.clusters[b] & cluster:
                    if not self.sources[b] & source:
                        return residual, place, 0
                    free_of_cluster = free_of_cluster or (residual, place, 1)
                any_bin = any_bin or (residual, place, 2)
        return free_of_cluster or any_bin

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put an item; (bin, degree of relaxation)."""
        found = self._search(size, source, cluster)
        if found and (not found[2] or len(self.sources) >= self.least):
            residual, place, relaxed = found
            here = self.at[residual]
            b = here.pop(place)
            if not here:
                del self.at[residual]
                self.residuals.pop(bisect_left(self.residuals, residual))
        else:
            residual, relaxed, b = self.capacity, 0, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if left := residual - size:
            if left not in self.at:
                self.at[left] = []
                insort(self.residuals, left)
            self.at[left].append(b)
        return b, relaxed


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and degree of relaxation of each item, taken in the given order."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    source_bit: dict = {}
    cluster_bit: dict = {}
    bins, where, relaxed = Bins(capacity, -(-sum(sizes) // capacity)), [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        sb = source_bit.setdefault(s, 1 << len(source_bit))
        cb = cluster_bit.setdefault(c, 1 << len(cluster_bit)) if seen[c] > 1 else 0
        b, r = bins.add(size, sb, cb)
        where.append(b)
        relaxed.append(r)
    return where, relaxed


def _pack(items: DataFrame, kind: str, groups: int, first_group: int, capacity: int, salt: str) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "__id", "piece"], ascending=[False, True, True])
        where, relaxed = best_fit(rows["size"].tolist(), rows["__source"].tolist(), rows["__cluster"].tolist(), capacity)
        out = rows.assign(container=(int(key[0]) << 32) + pd.Series(where, index=rows.index, dtype="int64"), relaxed=relaxed)
        out["unused"] = capacity - out.groupby("container")["size"].transform("sum")
        return out.drop(columns="__g")

    grouped = items.withColumn("__g", (F.pmod(F.xxhash64("__id", "piece", F.lit(salt)), F.lit(groups)) + first_group).cast("int"))
    return grouped.groupBy("__g").applyInPandas(run, _ROW.format(kind=kind) + ", container bigint, relaxed int, unused int")


def _groups(items: DataFrame, capacity: int) -> int:
    n, tokens = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("size").cast("bigint")), F.lit(0))).first()
    return max(1, -(-tokens // (capacity * GROUP_CONTAINERS)), -(-n // GROUP_ITEMS))


def pack_sizes(items: DataFrame, id_column: str, capacity: int = CAPACITY) -> DataFrame:
    """Containers of items (id_column, n_tokens, source, cluster BIGINT).

    Columns: id_column, piece, start, size, container, relaxed (0 compatible, 1 source shared, 2 cluster shared), unused.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = items.schema[id_column].dataType.simpleString()
    whole = (F.col("n_tokens") / capacity).cast("int")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int") - 1, F.lit(0)))
    cut = items.select(F.col(id_column).alias("__id"), "n_tokens", whole.alias("whole"), F.xxhash64("source").alias("__source"), F.col("cluster").alias("__cluster"), F.explode(pieces).alias("piece"))
    cut = durable(
        cut.select(
            "__id",
            "piece",
            (F.col("piece") * capacity).alias("start"),
            F.when(F.col("piece") < F.col("whole"), capacity).otherwise(F.col("n_tokens") - F.col("piece") * capacity).alias("size"),
            "__source",
            "__cluster",
        )
    )
    open_items = cut.filter(F.col("size").between(1, capacity - 1))
    groups = _groups(open_items, capacity)
    packed = durable(_pack(open_items, kind, groups, 0, capacity, "first"))
    if groups > 1:
        loose = packed.filter(F.col("unused") > capacity // LOOSE)
        again = _pack(loose.drop("container", "relaxed", "unused"), kind, _groups(loose, capacity), groups, capacity, "again")
        packed = packed.filter(F.col("unused") <= capacity // LOOSE).unionByName(again)
    #: Full pieces: a container each, numbered below zero in the order of their ids, so they meet no packed container.
    full = dense_index(cut.filter(F.col("size") == capacity), ["__id", "piece"], "container").withColumn("container", -1 - F.col("container"))
    full = full.withColumns({"relaxed": F.lit(0), "unused": F.lit(0)})
    none = cut.filter(F.col("size") < 1).withColumns({"container": F.lit(None).cast("bigint"), "relaxed": F.lit(0), "unused": F.lit(0)})
    return packed.unionByName(full).unionByName(none).select(F.col("__id").alias(id_column), "piece", "start", "size", "container", "relaxed", "unused")


def pack_texts(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, tokenizers: str = bpe.TOKENIZERS) -> DataFrame:
    """Containers of texts by their number of tokens; equal texts are a duplicate cluster."""
    rows = df.select(F.col(id_column), F.col(source).alias("source"), F.xxhash64(text).alias("cluster"), F.col(text).alias("__text"))
    counted = bpe.count_tokens(rows, "__text", tokenizers)
    return pack_sizes(counted, id_column, capacity)
