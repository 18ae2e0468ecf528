"""Transitive closure of a binary relation by semi-naive iteration over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import persisted


def closure(pairs: DataFrame, start: Column | None = None, end: Column | None = None, most: int = 10_000) -> DataFrame:
    """Distinct (a, b) such that one or more steps lead from a to b; cycles end.

    With `start` or `end` (constants) only paths from or to it are followed, in that direction,
    a step a round. Otherwise each round joins the newest pairs with all known ones, so that
    paths double in length. Pairs already known are dropped.
    """
    steps = persisted(pairs.distinct())
    back = start is None and end is not None
    new = steps.where(F.col("b" if back else "a") == (end if back else start)) if start is not None or back else steps
    seen = new = persisted(new)
    for _ in range(most):
        near = (seen if start is None and end is None else steps).select(F.col("a").alias("x"), F.col("b").alias("y"))
        if back:
            grown = near.join(new, F.col("y") == F.col("a")).select(F.col("x").alias("a"), "b")
        else:
            grown = new.join(near, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))
        new = persisted(grown.distinct().join(seen, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.union(new)
    raise RuntimeError(f"no fixed point after {most} rounds")
