"""Append-only versions: what is in force, what was replaced, what comes latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.shared import checkpointed


def in_force(rows: DataFrame, row_id: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = rows.select(F.col(supersedes).alias("__gone")).where("__gone is not null").distinct()
    return rows.join(gone, rows[row_id] == gone["__gone"], "left_anti")


def effective(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The top version of each key, with `is_ambiguous` where several rows share it (the first by all columns is taken)."""
    top = Window.partitionBy(*keys)
    order = top.orderBy(F.desc(version), *[c for c in rows.columns if c != version])
    marked = rows.withColumn("__n", F.row_number().over(order)).withColumn("__top", F.max(version).over(top))
    marked = marked.withColumn("is_ambiguous", F.count_if(F.col(version) == F.col("__top")).over(top) > 1)
    return marked.where("__n = 1").drop("__n", "__top")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", n).where(F.col("rank") <= k)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order; pages count from 1 and have 1 to 100 rows."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def out_of_order(rows: DataFrame, ordinal: str, order: list[str], group: str | None = None, width: int = 10_000) -> DataFrame:
    """Rows that come before their predecessor's place in `order`, by their ordinal, within a group or in all.

    ordinal: a whole number. Rows are looked at in ranges of `width` ordinals;
    the last row of each range is compared with the first of the next that has
    any, so that no task sees all rows.
    """
    keys = [group] if group else []
    there = rows.withColumns({"__r": F.floor(F.col(ordinal) / width), "__now": F.struct(*order)})
    inner = Window.partitionBy(*keys, "__r").orderBy(ordinal)
    ends = there.groupBy(*keys, "__r").agg(F.max_by("__now", ordinal).alias("__last"))
    above = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__r").alias("__q"), F.lag("__last").over(Window.partitionBy(*keys).orderBy("__r")).alias("__before"))
    told = there.withColumn("__own", F.lag("__now").over(inner))
    met = told.join(above, [*[told[k].eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__r") == F.col("__q")])
    return met.where(F.coalesce("__own", "__before") > F.col("__now")).select(*rows.columns)


def lifecycle(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`events` with a state: the last ratified event of each key is ACTIVE (without one, the last), the others SUPERSEDED.

    events: a boolean column `ratified`.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("ratified", F.lit(False))), *order))
    return events.withColumn("state", F.when(n == 1, "ACTIVE").otherwise("SUPERSEDED"))


def in_circle(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(id) of the rows whose line of parents leads back to themselves, however long the way.

    Each child has one parent at most (more are an error). The parent's parent is
    taken in every round, so a way of n steps takes log2(n) rounds; where all
    rows are by then that still have one is on a circle. Rounds are cut by
    checkpoints.
    """
    pairs = checkpointed(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct())
    if not pairs.groupBy("c").count().where("count > 1").isEmpty():
        raise ValueError("a row has several parents")
    steps, most = 1, pairs.count()
    while steps < most:
        after = pairs.select(F.col("c").alias("b"), F.col("p").alias("q"))
        pairs, steps = checkpointed(pairs.join(after, pairs["p"] == after["b"]).select("c", F.col("q").alias("p"))), 2 * steps
    return pairs.select(F.col("p").alias("id")).distinct()
