"""Samples whose category shares match given targets (problem 3).

Calibration: within each block the inclusion probabilities start from one design probability and are tilted exponentially,
``p = d * exp(lambda . x)``. The moments ``x`` overlap: the category of a row, whose expected number must equal its target, and the bin of
a measure, whose share in the sample should be that in the block, so that a sample with other category shares still covers the measure as
the block does. Rows per block, category and bin are aggregated with map-side combine; Newton's method solves the dual of each block over
these cells only. Category totals are hard; bins are weighed by a ridge in the dual, since both together need not be attainable. Categories
that need all their rows are fixed at 1, those that need none at 0, and cells that would exceed 1 are fixed there, the others solved again,
until none does. The gap of a category is its need less the calibrated expectation.

The sample is then drawn with the pivotal method, in which rows duel for probability: first within shards of a (block, category), then among
the at most one undecided row of each shard. Since a category's probabilities sum to an integer, it gets exactly that number of rows.

The need of a category is the larger of its minimum and its target share of the sample size, rounded half up; a sample may thus
exceed its size where minima demand it. Rows equal in all measures count once and are represented by the smallest row id.

Defined cases: rows with a null block or category, or without a target, are never drawn; a target without rows has supply 0;
unusable rows (null, NaN or non-positive measures) are left out; empty tables give empty results; the tables' other columns,
whatever their names, are unused.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockframe.operators.skew import fragment_replicate_join

#: Rows of a (block, category) that one pivotal shard holds about.
SHARD = 50_000
TOLERANCE = 1e-9
#: Bins of a measure for each doubling, and the bin of infinity; ridge of a bin's moment in shares of its target.
BINS, LAST_BIN, RIDGE = 4, 10_000, 1.0


def usable(columns: list[str]) -> Column:
    """Whether all measures are present, numbers, and above 0."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0), F.lit(False))
    return out


def finite(columns: list[str]) -> Column:
    """Usable measures that are also finite, so that distances are numbers."""
    out = usable(columns)
    for c in columns:
        out = out & (F.col(c) < F.lit(float("inf")))
    return out


def bin_of(measure: str) -> Column:
    """The bin of a positive measure, on a scale that does not depend on the data."""
    return F.when(F.col(measure) < F.lit(float("inf")), F.floor(F.log2(measure) * BINS)).otherwise(F.lit(LAST_BIN)).cast("int")


def distinct_units(df: DataFrame, row_id: str, block: str, category: str, measures: list[str]) -> DataFrame:
    """(row_id, block, category, bin): one row for each distinct vector of measures in a block and category; bins are of the first measure."""
    rows = df.filter(usable(measures)).filter(F.col(block).isNotNull() & F.col(category).isNotNull())
    return rows.groupBy(block, category, *measures).agg(F.min(row_id).alias(row_id)).select(row_id, block, category, bin_of(measures[0]).alias("bin"))


def newton_dual(x: np.ndarray, n: np.ndarray, target: np.ndarray, d: float, ridge: np.ndarray | float = 0.0, rounds: int = 200) -> np.ndarray:
    """Probabilities ``d * exp(x @ lam)`` of cells of ``n`` rows whose moments ``x.T @ (n * p)`` are ``target - ridge * lam``.

    Newton steps on the dual, no coordinate by more than 2 at once, since far from the solution the exponential outruns the quadratic model.
    """
    lam, ridge = np.zeros(x.shape[1]), np.broadcast_to(np.asarray(ridge, float), (x.shape[1],))
    for _ in range(rounds):
        p = d * np.exp(x @ lam)
        gap = target - x.T @ (n * p) - ridge * lam
        if np.all(np.abs(gap) <= TOLERANCE * np.maximum(1, target)):
            break
        step = np.linalg.lstsq(x.T @ (x * (n * p)[:, None]) + np.diag(ridge), gap, rcond=None)[0]
        lam += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
    return d * np.exp(x @ lam)


def tilt(category: np.ndarray, bins: np.ndarray, n: np.ndarray, target: dict) -> np.ndarray:
    """Inclusion probabilities of the cells of a block: ``target`` rows of each category, bins as in the block where that can be."""
    everything = sum(target.values())
    names, at = np.unique(bins, return_inverse=True)
    want = np.bincount(at, n, len(names)) / max(n.sum(), 1) * everything
    need, supply = np.array([target[c] for c in category], float), np.array([n[category == c].sum() for c in category], float)
    p = np.where((supply > 0) & (need >= supply), 1.0, 0.0)
    free = (need > 0) & (need < supply)
    while free.any():
        kinds = np.unique(category[free])
        left = np.array([target[c] - (n * p)[(category == c) & ~free].sum() for c in kinds])
        room = want - np.bincount(at[~free], (n * p)[~free], len(names))
        x = np.concatenate([category[free][:, None] == kinds, at[free][:, None] == np.arange(len(names))], axis=1).astype(float)
        ridge = np.r_[np.zeros(len(kinds)), RIDGE * np.maximum(want, 1.0)]
        start = min(1.0, max(left.sum(), TOLERANCE) / n[free].sum())
        q = newton_dual(x, n[free].astype(float), np.r_[left, np.maximum(room, 0.0)], start, ridge)
        reached = x[:, : len(kinds)].T @ (n[free] * q)
        q = q * (x[:, : len(kinds)] @ (left / np.maximum(reached, 1e-300)))  # category totals to the last digit
        over = q > 1 + TOLERANCE
        p[free] = np.minimum(q, 1.0)
        if not over.any():
            break
        free[np.flatnonzero(free)[over]] = False
    return p


def need_of(share: Column, size: Column, least: Column) -> Column:
    return F.greatest(least.cast("bigint"), F.floor(share * size + F.lit(0.5)).cast("bigint"))


def calibrate(units: DataFrame, targets: DataFrame, block: str, category: str) -> DataFrame:
    """One row per target and bin of its rows: block, category, bin, n, need, supply, gap (missing rows), expected (rows the sample gets), p, shards.

    A target without rows has one row with a null bin.
    """
    moments = units.groupBy(block, category, "bin").agg(F.count(F.lit(1)).alias("n"))
    need = need_of(F.col("target_share"), F.col("sample_size"), F.col("min_rows"))
    cells = targets.select(block, category, need.alias("need")).join(moments, [block, category], "left").fillna(0, ["n"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([category, "bin"])
        kinds, n = pd.factorize(rows[category])[0], rows["n"].to_numpy(float)
        supply = np.bincount(kinds, n)
        need = np.maximum.reduceat(rows["need"].to_numpy(float), np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]))
        p = tilt(kinds, rows["bin"].fillna(-1).to_numpy(), n, dict(enumerate(np.minimum(need, supply))))
        expected = np.rint(np.bincount(kinds, n * p)).astype("int64")
        return rows.assign(supply=supply[kinds].astype("int64"), gap=need[kinds].astype("int64") - expected[kinds], expected=expected[kinds], p=np.clip(p, 0, 1))

    kinds = [f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in (block, category)]
    out = cells.groupBy(block).applyInPandas(solve, f"{', '.join(kinds)}, bin int, n bigint, need bigint, supply bigint, gap bigint, expected bigint, p double")
    return out.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("supply") / SHARD)).cast("int"))


def report(cells: DataFrame, block: str, category: str) -> DataFrame:
    """One row per target: block, category, need, supply, gap, expected, and the mean inclusion probability p."""
    whole = [F.first(c).alias(c) for c in ("need", "supply", "gap", "expected")]
    mean = F.coalesce(F.sum(F.col("n") * F.col("p")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))
    return cells.groupBy(block, category).agg(*whole, mean.alias("p"))


def pivotal(p: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Probabilities after the duels of the rows in turn: all 0 or 1 but for at most one."""
    p = p.astype(float).copy()
    duels = random.random(len(p)).tolist()
    values, k = p.tolist(), -1
    for i, b in enumerate(values):
        if b <= TOLERANCE or b >= 1 - TOLERANCE:
            values[i] = round(b)
            continue
        if k < 0:
            k = i
            continue
        a = values[k]
        if a + b <= 1:
            if duels[i] * (a + b) < b:
                values[k], values[i], k = 0.0, a + b, i
            else:
                values[k], values[i] = a + b, 0.0
        elif duels[i] * (2 - a - b) < 1 - a:
            values[k], values[i] = a + b - 1, 1.0
        else:
            values[k], values[i], k = 1.0, a + b - 1, i
        if k >= 0 and not TOLERANCE < values[k] < 1 - TOLERANCE:
            values[k] = float(round(values[k]))
            k = -1
    return np.array(values)


def draw(units: DataFrame, cells: DataFrame, row_id: str, block: str, category: str, seed: int = 42) -> DataFrame:
    """The sampled rows of ``units``: row_id, block, category, p."""
    chosen = cells.filter("p > 0").select(block, category, "bin", "p", "shards")
    rows = fragment_replicate_join(units, chosen, [block, category, "bin"]).drop("bin")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(row_id, F.lit(seed)), F.col("shards")).cast("int")).withColumn("q", F.col("p"))
    fields = [f"`{c}` {units.schema[c].dataType.simpleString()}" for c in (row_id, block, category)]
    schema = f"{', '.join(fields)}, p double, shards int, shard int, q double"

    def duel(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        random = np.random.default_rng([seed, *(zlib.crc32(str(k).encode()) for k in key)])
        part = part.sort_values(row_id)
        part = part.iloc[random.permutation(len(part))]
        part["q"] = pivotal(part["q"].to_numpy(), random)
        return part[part["q"] > 0]

    first = rows.filter("p < 1").groupBy(block, category, "shard").applyInPandas(duel, schema)
    #: One more round over the undecided rows, at most one of each shard; (block, category) without any passes through.
    undecided = (F.col("q") > 0) & (F.col("q") < 1)
    last = first.filter(undecided).groupBy(block, category).applyInPandas(duel, schema)
    whole = rows.filter("p = 1").select(row_id, block, category, "p")
    return whole.unionByName(first.filter("q = 1").select(row_id, block, category, "p")).unionByName(last.filter("q = 1").select(row_id, block, category, "p"))
