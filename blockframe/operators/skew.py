"""Per-key results where a few keys hold most rows (problem 4).

Fragment-replicate by load: the exact row counts of the keys give a plan (:mod:`blockframe.plans.balance`) that packs keys into tasks
and splits large keys into shards in proportion to their rows. Aggregates are pre-aggregated on the map side, one Arrow batch
at a time; the partial states carry the numbers of rows that the plan is made from, and only they travel to the planned task;
shards of a key are merged last. A join copies the matching side to the shards of its key and nowhere else.

Defined cases, in every operator of this module:

* a null key belongs to no group of :func:`key_statistics`, but its rows count in the total of the heavy-key share;
* null values add to the number of rows and to neither mean nor maximum; a key without any value has null mean and last;
* repeated rows count as they stand; an empty table gives an empty result; other columns, whatever their names, are unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockframe.plans.balance import Plan, make_plan, replicate, route
from blockframe.plans.runtime import durable

PARTIAL = "field string, key_value bigint, n bigint, v_sum double, v_n bigint, t_max bigint"


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aggregate states of each batch: rows, sum and count of values, latest time, by field and key."""
    for batch in batches:
        grouped = pa.Table.from_batches([batch]).group_by(["field", "key_value"]).aggregate([([], "count_all"), ("v", "sum"), ("v", "count"), ("t", "max")])
        columns = [grouped["field"], grouped["key_value"], grouped["count_all"], pc.cast(grouped["v_sum"], pa.float64()), grouped["v_count"], grouped["t_max"]]
        names = ["field", "key_value", "n", "v_sum", "v_n", "t_max"]
        yield from pa.table(dict(zip(names, columns, strict=True))).combine_chunks().to_batches()


def unpivot_keys(df: DataFrame, keys: list[str], value: str, time: str, *extra: Column) -> DataFrame:
    """(field, key_value, v, t, *extra): one row for each non-null key of each row."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("bigint").alias("key_value")) for k in keys])
    more = df.select(*extra).columns
    return (
        df.select(F.explode(pairs).alias("p"), F.col(value).cast("double").alias("v"), F.col(time).cast("bigint").alias("t"), *extra)
        .select("p.field", "p.key_value", "v", "t", *more)
        .filter(F.col("key_value").isNotNull())
    )


def key_statistics(df: DataFrame, keys: list[str], value: str, time: str, heavy_share: float = 0.02, tasks: int | None = None) -> DataFrame:
    """For every non-null value of each of ``keys``: rows, mean ``value``, last ``time``, and whether it is heavy.

    A key is heavy when it occurs in at least ``heavy_share`` of all rows of ``df``. Columns: field, key_value, n_rows,
    mean_value, last_time, share, is_heavy.
    """
    total = df.count()
    long = unpivot_keys(df, keys, value, time)
    states = durable(long.mapInArrow(_partials, PARTIAL))  # read twice: for the plan and by it
    plan = make_plan(states.select("field", "key_value", "n"), ["field", "key_value"], tasks, weight="n")
    merged = [F.sum("n").alias("n"), F.sum("v_sum").alias("v_sum"), F.sum("v_n").alias("v_n"), F.max("t_max").alias("t_max")]
    in_task = route(states, ["field", "key_value"], plan).groupBy("__task", "field", "key_value").agg(*merged)
    whole = in_task.groupBy("field", "key_value").agg(*merged) if plan.heavy else in_task
    return whole.select(
        "field",
        "key_value",
        F.col("n").alias("n_rows"),
        F.when(F.col("v_n") > 0, F.col("v_sum") / F.col("v_n")).alias("mean_value"),
        F.col("t_max").alias("last_time"),
        (F.col("n") / F.lit(total)).alias("share"),
        (F.col("n") >= F.lit(heavy_share) * F.lit(total)).alias("is_heavy"),
    )


def fragment_replicate_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", plan: Plan | None = None, spread: list[str] | None = None) -> DataFrame:
    """Join ``big`` with ``small`` on ``keys`` so that no key of ``big`` falls to one task alone.

    ``how`` is ``inner`` or ``left``. Rows of ``big`` are spread over the shards of their key by a hash of the columns ``spread`` (default:
    all); rows of ``small`` are copied to those shards only. A null key matches nothing. Columns of ``small`` other than the keys must not clash with ``big``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    clash = (set(big.columns) & set(small.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    plan = plan or make_plan(big.select(*keys), keys)
    left, right = route(big, keys, plan, spread), replicate(small, keys, plan)
    return left.join(right, ["__task", *keys], how).drop("__task")
