"""Load-aware routing: which task handles which key, with large keys split over several tasks.

A plan is made from exact loads of at most ``1 / share`` heavy keys and of a fixed number of hash buckets that hold all
other keys, so its size does not depend on the data. Buckets and shards of heavy keys are packed into tasks, longest
first. Rows reach their task with ``repartitionById``; a key-wise matching side is replicated to the shards of heavy keys
only. The shard of a row follows from a hash of its values, so a stage that runs again sends every row where it went before.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockframe.plans.runtime import shuffle_tasks

BUCKETS = 1024
#: Makes the hash of shards another one than that of buckets.
SHARD_SEED = 7


@dataclass
class Plan:
    """Where keys go. ``heavy`` maps a key (a tuple) to the tasks of its shards, ``buckets`` a hash bucket to its task."""

    tasks: int
    buckets: list[int]
    heavy: dict[tuple, list[int]] = field(default_factory=dict)
    loads: list[float] = field(default_factory=list)


def pack(sizes: list[tuple[float, object]], tasks: int) -> tuple[dict, list[float]]:
    """Assign each (size, name) to the least loaded of ``tasks`` bins, largest first."""
    heap = [(0.0, t) for t in range(tasks)]
    at: dict = {}
    loads = [0.0] * tasks
    for size, name in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, t = heapq.heappop(heap)
        at[name] = t
        loads[t] = load + size
        heapq.heappush(heap, (loads[t], t))
    return at, loads


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def make_plan(df: DataFrame, keys: list[str], tasks: int | None = None, buckets: int = BUCKETS, slack: float = 0.25, weight: str | None = None) -> Plan:
    """Plan the keys of ``df`` from their exact row counts, or from the sums of a column ``weight`` where a row stands for several.

    A key becomes heavy when its load exceeds ``slack`` of an even share of a task; there are at most ``tasks / slack`` of
    them. One job sums loads by key with map-side combine and brings ``buckets`` rows to the driver.
    """
    tasks = tasks or shuffle_tasks(df.sparkSession)
    load = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys).agg(load.alias("__n"))
    total = df.agg(load).first()[0]
    if not total:
        return Plan(tasks, [b % tasks for b in range(buckets)])
    even = total / tasks
    large = F.col("__n") > F.lit(even * slack)
    rows = (
        counts.groupBy(_bucket(keys, buckets).alias("__b"))
        .agg(
            F.sum(F.when(large, 0).otherwise(F.col("__n"))).alias("light"),
            F.collect_list(F.when(large, F.struct(*keys, "__n"))).alias("large"),
        )
        .collect()
    )
    sizes: list[tuple[float, object]] = [(float(r["light"]), ("bucket", r["__b"])) for r in rows]
    shards: dict[tuple, int] = {}
    for r in rows:
        for x in r["large"]:
            key = tuple(tuple(v) if isinstance(v := x[k], list) else v for k in keys)
            shards[key] = max(1, -(-int(x["__n"]) // max(1, int(even * slack))))
            sizes += [(x["__n"] / shards[key], ("key", key, s)) for s in range(shards[key])]
    at, loads = pack(sizes, tasks)
    where = [at.get(("bucket", b), b % tasks) for b in range(buckets)]
    return Plan(tasks, where, {k: [at[("key", k, s)] for s in range(n)] for k, n in shards.items()}, loads)


def _shards_of(plan: Plan, keys: list[str], df: DataFrame) -> DataFrame:
    """``df`` with ``__tasks``: the tasks of the row's key if it is heavy, else null. The joined table is the bounded plan."""
    spark = df.sparkSession
    fields = [df.schema[k] for k in keys]
    schema = ", ".join(f"`__k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", __tasks array<int>"
    small = spark.createDataFrame([(*k, t) for k, t in plan.heavy.items()], schema)
    on = [df[k].eqNullSafe(small[f"__k{i}"]) for i, k in enumerate(keys)]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return df.join(F.broadcast(small), condition, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def _light_task(plan: Plan, keys: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in plan.buckets]), _bucket(keys, len(plan.buckets)) + 1)


def route(df: DataFrame, keys: list[str], plan: Plan, spread: list[str] | None = None) -> DataFrame:
    """``df`` with ``__task``, each row in the partition of that number.

    A row of a heavy key goes to the shard that the hash of its columns ``spread`` (default: all) gives; rows equal in these stay together,
    so give columns that tell rows apart.
    """
    out = df
    task = _light_task(plan, keys)
    if plan.heavy:
        out = _shards_of(plan, keys, out)
        shard = F.pmod(F.xxhash64(F.lit(SHARD_SEED), *(spread or df.columns)), F.size("__tasks").cast("long")).cast("int")
        task = F.when(F.col("__tasks").isNotNull(), F.element_at("__tasks", shard + 1)).otherwise(task)
        out = out.withColumn("__task", task).drop("__tasks")
    else:
        out = out.withColumn("__task", task)
    return out.repartitionById(plan.tasks, F.col("__task"))


def replicate(df: DataFrame, keys: list[str], plan: Plan) -> DataFrame:
    """The matching side: one copy of each row for every task that holds rows of its key, in that task's partition."""
    light = F.array(_light_task(plan, keys))
    if plan.heavy:
        tasks = F.when(F.col("__tasks").isNotNull(), F.array_distinct("__tasks")).otherwise(light)
        out = _shards_of(plan, keys, df).withColumn("__task", F.explode(tasks)).drop("__tasks")
    else:
        out = df.withColumn("__task", F.explode(light))
    return out.repartitionById(plan.tasks, F.col("__task"))
