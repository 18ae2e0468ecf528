"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins; no task gets more than the edges of its keys,
joins are between stored tables, so that adaptive execution can split a node with very many
edges, and nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, uses


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links (i, j) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """For every id in edges (a, b): the smallest id it reaches. Columns id, component; discard() it after use.

    Null ends, loops and repeated edges are ignored; no edges give an empty table.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "large")
        lower = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stored(small.select("e.a", "e.b").where("a > b").distinct(), "edges")
        discard(now, least, large, lower)
        now = after
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    return uses(found, now)
