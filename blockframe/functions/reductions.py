"""Row and column statistics of arrays as partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from blockframe.dsarray import WIDE, DsArray

#: Ranks of approximate quantiles are off by at most a share of one over this.
ACCURACY = 10_000

_AGGREGATES = {
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "mean": F.avg,
    "norm": lambda x: F.sqrt(F.sum(x * x)),
    "var": F.var_pop,
    "std": F.stddev_pop,
    "nonzero_mean": lambda x: F.coalesce(F.avg(F.when(x != 0, x)), F.lit(0.0)),
}


def _sparse(a: DsArray, key: str, size: int, other: int, name: str):
    """(key, v) statistics over stored values and implicit zeros."""
    v = F.col("v")
    n = F.count(F.lit(1))
    some = n < F.lit(other)
    made = {
        "sum": F.sum(v),
        "mean": F.sum(v) / F.lit(float(other)),
        "min": F.when(some, F.least(F.min(v), F.lit(0.0))).otherwise(F.min(v)),
        "max": F.when(some, F.greatest(F.max(v), F.lit(0.0))).otherwise(F.max(v)),
        "nonzero_mean": F.avg(F.when(v != 0, v)),
    }[name]
    got = a.df.groupBy(key).agg(made.alias("v"))
    every = a.df.sparkSession.range(size).withColumnRenamed("id", key)
    return every.join(got, key, "left").fillna(0.0, ["v"])


def by_column(a: DsArray, name: str) -> DsArray:
    """A 1 x m array of a statistic of every column."""
    n, m = a.shape
    if a.sparse:
        cells = _sparse(a, "j", m, n, name)
    elif name == "median":
        cells = _medians(a)
    elif m <= WIDE:
        row = a.df.agg(F.array(*[_AGGREGATES[name](F.get("features", F.lit(j))) for j in range(m)]).alias("features"))
        return DsArray(row.select(F.lit(0).cast("bigint").alias("row_idx"), "features"), (1, m))
    else:
        cells = a.entries().groupBy("j").agg(_AGGREGATES[name](F.col("v")).alias("v"))
    row = cells.agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("features"))
    return DsArray(row.select(F.lit(0).cast("bigint").alias("row_idx"), "features"), (1, m))


def _medians(a: DsArray):
    """(j, v): exact medians of columns. Approximate quantiles bracket each; only the few distinct values between them are ranked."""
    n, cells = a.shape[0], a.entries()
    near = cells.groupBy("j").agg(F.percentile_approx("v", [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY).alias("b"))
    placed = cells.join(near, "j").withColumn("side", F.when(F.col("v") < F.col("b")[0], -1).when(F.col("v") > F.col("b")[1], 1).otherwise(0))
    #: Values outside the bracket are counted only.
    counts = placed.groupBy("j", "side", F.when(F.col("side") == 0, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("j").orderBy("side", "v"))
    ranked = counts.withColumn("upto", upto).filter("side = 0")
    holds = [(F.col("upto") > r) & (F.col("upto") - F.col("n") <= r) for r in ((n - 1) // 2, n // 2)]
    return ranked.groupBy("j").agg(((F.max(F.when(holds[0], F.col("v"))) + F.max(F.when(holds[1], F.col("v")))) / 2).alias("v"))


def _middle(x: Column) -> Column:
    s, n = F.array_sort(x), F.size(x)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def by_row(a: DsArray, name: str) -> DsArray:
    """An n x 1 array of a statistic of every row."""
    n, m = a.shape
    if a.sparse:
        cells = _sparse(a, "i", n, m, name)
        return DsArray(cells.select(F.col("i").alias("row_idx"), F.array("v").alias("features")), (n, 1))
    x = F.col("features")
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    made = {
        "min": lambda: F.array_min(x),
        "max": lambda: F.array_max(x),
        "sum": lambda: total,
        "mean": lambda: total / F.lit(float(m)),
        "median": lambda: _middle(x),
        "norm": lambda: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)),
    }[name]()
    return DsArray(a.df.select("row_idx", F.array(made).alias("features")), (n, 1))
