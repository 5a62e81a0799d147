"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import saved


def _least(edges: DataFrame) -> DataFrame:
    """For every (u, v): v with the least of u and all neighbours of u given with it."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of `edges` (columns a, b): the least id reachable.

    Alternates two steps until nothing changes: each node's larger neighbours
    are linked to its least neighbour, then its smaller ones. Both only take a
    minimum for each node, which is combined before the shuffle, so a node with
    very many neighbours does no harm. Repeated edges and loops are allowed; an
    empty table gives an empty one. Each round is cut by a checkpoint.
    """
    pair = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pair = saved(pair)
    before = _state(pair)
    while True:
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        pair = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _state(pair)
        if after == before:
            break
        before = after
    return pair.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pair.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
