"""Closures of parent-child trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import QueryError


def closure_of(nodes: DataFrame, key: str, parent: str, most_levels: int = 64) -> DataFrame:
    """(parent_id, child_id, distance) of every node with itself and each of its ancestors.

    One join per level, kept so that the next one doesn't repeat it; the levels are counted while rows come.  A tree deeper than most_levels, or a cycle, is an error.
    """
    links = nodes.select(F.col(key).alias("child_id"), F.col(parent).alias("up"))
    level = links.select(F.col("child_id").alias("parent_id"), "child_id", F.col("up").alias("next"), F.lit(0).alias("distance"))
    out = level.select("parent_id", "child_id", "distance")
    above = links.select(F.col("child_id").alias("at"), F.col("up").alias("over"))
    for depth in range(1, most_levels + 1):
        level = level.filter("next is not null").join(above, F.col("next") == F.col("at")).select(F.col("next").alias("parent_id"), "child_id", F.col("over").alias("next"), F.lit(depth).alias("distance")).persist()
        if level.isEmpty():
            return out
        out = out.unionByName(level.select("parent_id", "child_id", "distance"))
    raise QueryError(f"the tree is deeper than {most_levels} levels or has a cycle")
