"""Dense row numbers and distributed sums of fixed-length states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.plans.runtime import durable, shuffle_tasks

ARITY, DRIVER_VALUES = 32, 8_000_000


def dense_index(df: DataFrame, order: list, name: str = "row_idx") -> DataFrame:
    """``df`` with a dense BIGINT row number from 0 in the given total order.

    A range-partitioned sort is cut off, rows are numbered within partitions, and one offset per partition is added; no
    window over all rows and nothing but partition sizes on the driver.
    """
    ordered = durable(df.orderBy(*order)).withColumn("__dense_id", F.monotonically_increasing_id())
    part, place = F.shiftright("__dense_id", 33), F.col("__dense_id").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        offsets[r["part"]], total = total, total + r["n"]
    if not offsets:
        return ordered.withColumn(name, F.col("__dense_id")).drop("__dense_id")
    starts = df.sparkSession.createDataFrame(list(offsets.items()), "__dense_part bigint, __dense_start bigint")  # a row per partition
    return ordered.withColumn("__dense_part", part).join(F.broadcast(starts), "__dense_part").withColumn(name, F.col("__dense_start") + place).drop("__dense_id", "__dense_part", "__dense_start")


def cumulate(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, dict]:
    """``df`` with running sums ``cum_*`` of ``columns`` in the order of its unique ``key``, and ``next``, the following key; and the totals.

    Rows are range-partitioned; running sums and neighbours are windows within partitions, moved on by one row of offsets per partition.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    ordered = durable(df.orderBy(key)).withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 33))
    parts = sorted(ordered.groupBy("__part").agg(F.min(key).alias("k"), *[F.sum(c).alias(c) for c in columns]).collect(), key=lambda r: r["__part"])
    kind = {f.name: f.dataType.simpleString() for f in ordered.groupBy().agg(F.min(key).alias(key), *[F.sum(c).alias(c) for c in columns]).schema}
    totals, starts = {c: 0.0 if kind[c] == "double" else 0 for c in columns}, []
    for i, r in enumerate(parts):
        starts.append((r["__part"], parts[i + 1]["k"] if i + 1 < len(parts) else None, *totals.values()))
        totals = {c: totals[c] + (r[c] or 0) for c in columns}
    offsets = spark.createDataFrame(starts, f"__part bigint, __next {kind[key]}, " + ", ".join(f"`__{c}` {kind[c]}" for c in columns))
    w = Window.partitionBy("__part").orderBy(key)
    out = ordered.join(F.broadcast(offsets), "__part")  # a row per partition
    for c in columns:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(w) + F.col(f"__{c}"))
    out = out.withColumn("next", F.coalesce(F.lead(key).over(w), "__next"))
    return out.drop("__part", "__next", *[f"__{c}" for c in columns]), totals


def reduce_partitions(df: DataFrame, merge: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, arity: int) -> DataFrame:
    """Merge the rows of all partitions into at most ``arity`` ones, in two levels where there are more shuffle tasks than that.

    ``merge`` sees a partition as a stream of batches, so its memory does not grow with the number of partitions.
    """
    tasks = shuffle_tasks(df.sparkSession)
    for n in ([tasks] if tasks > arity else []) + [arity]:
        df = df.repartitionById(n, F.pmod(F.spark_partition_id(), F.lit(n))).mapInPandas(merge, schema)
    return df


def sum_states(df: DataFrame, state: Callable[[Iterator[pd.DataFrame]], np.ndarray], length: int) -> np.ndarray:
    """Sum over partitions of ``state`` (a vector of ``length``).

    The driver gets at most ``ARITY`` vectors, and fewer where they are long: ``DRIVER_VALUES`` values in all, or one vector.
    """
    arity = max(1, min(ARITY, DRIVER_VALUES // max(1, length)))

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"s": [np.asarray(state(parts), float).ravel()]})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for p in parts:
            for s in p["s"]:
                total = np.array(s, float) if total is None else total + s
        if total is not None:
            yield pd.DataFrame({"s": [total]})

    rows = reduce_partitions(df.mapInPandas(partial, "s array<double>"), add, "s array<double>", arity).collect()
    return np.sum([np.array(r["s"], float) for r in rows], axis=0) if rows else np.zeros(length)


def stack(column: pd.Series, width: int = 0) -> np.ndarray:
    """A column of equal-length arrays as a matrix."""
    return np.array(column.to_list(), float) if len(column) else np.zeros((0, width))
