"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import forget, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of u to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges go from larger u to smaller v: join u and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node that has a link to a smaller one; component_id is the least node.

    edges: two long columns u, v, in any direction and any number of times; loops and nulls count
    for nothing. A node that is absent from the result is the least of its component. Each round is
    two aggregates and two equality joins over the links and is written to the shared folder, so
    neither a component nor a node's neighbours are ever gathered; the rounds grow with the
    logarithm of the longest chain.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        after = settle(_small_star(_large_star(now)))
        forget(now)
        now, before, state = after, state, _state(after)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
