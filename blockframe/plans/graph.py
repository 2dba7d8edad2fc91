"""Connected components, in memory for one task's points and by contraction for distributed edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.plans.runtime import durable


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of the component of each of n points, given edges."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, low, high = u[apart], v[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def contract(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of the component of every node of ``edges`` (u, v), by rounds of contraction.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their ends, and contracts the edges, which
    shrink from round to round. Lineage is cut with reliable checkpoints.
    """
    edges = durable(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct())
    roots = None
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to"))
        ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        hooks = durable(ends.join(hooks, "node", "left").select("node", F.coalesce("to", "node").alias("to")))
        while True:
            onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = durable(hooks.join(onward, "to").select("node", F.col("end").alias("to"), (F.col("to") != F.col("end")).alias("moved")))
            hooks = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break
        if roots is None:
            roots = hooks.select("node", F.col("to").alias("root"))
        else:
            step = hooks.select(F.col("node").alias("root"), "to")
            roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = durable(roots)
        a, b = (hooks.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in "uv")
        new = edges.join(a, "u").join(b, "v").select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v"))
        edges = durable(new.filter("u < v").distinct())
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
