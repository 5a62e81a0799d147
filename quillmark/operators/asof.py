"""Backward as-of resolution of prices, by buckets so that it is an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A price counts up to so many days back. Fixed value.
LOOKBACK = 29


def resolve_dates(targets: DataFrame, days: DataFrame, target: str, day: str, out: str, lookback: int = LOOKBACK) -> DataFrame:
    """`targets` with `out`, the latest of `days` at or before the target, `lookback` days before it at most; else null.

    Both sides meet in buckets of lookback + 1 days: a day is listed in its own
    bucket and the next, so the right one is in the target's. Days are distinct
    dates, far fewer than targets, and only the distinct targets are resolved.
    """
    width = lookback + 1
    epoch = lambda c: F.floor(F.unix_date(c) / width)
    listed = days.select(F.col(day).alias("__day")).where("__day is not null").distinct().select("__day", F.explode(F.array(epoch(F.col("__day")), epoch(F.col("__day")) + 1)).alias("__bucket"))
    wanted = targets.select(F.col(target).alias("__target")).where("__target is not null").distinct().select("__target", epoch(F.col("__target")).alias("__bucket"))
    met = wanted.join(listed, "__bucket").where((F.col("__day") <= F.col("__target")) & (F.col("__day") >= F.date_sub("__target", lookback)))
    found = met.groupBy("__target").agg(F.max("__day").alias(out))
    return targets.join(found, targets[target] == found["__target"], "left").drop("__target")


def asof_by_key(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, value: str, out: str) -> DataFrame:
    """`left` with the value of `right` of the same key that is the latest at or before the row's moment, whatever its age.

    One union, one shuffle by key and one running window; no join.
    """
    a = left.select(F.struct(*left.columns).alias("row"), F.col(key).alias("__k"), F.col(left_on).alias("__t"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(key).alias("__k"), F.col(right_on).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    until = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__found", F.last("__v", ignorenulls=True).over(until))
    return both.where("__side = 1").select("row.*", F.col("__found").alias(out))


def observed(obs: DataFrame, prices: DataFrame, symbol: str, day: Column, value: str, out: str) -> DataFrame:
    """`obs` with the price of its symbol on a day (left join; null where there is none)."""
    p = prices.select(F.col("symbol").alias("__s"), F.col("day").alias("__d"), F.col(value).alias(out))
    return obs.join(p, (obs[symbol] == p["__s"]) & (day == p["__d"]), "left").drop("__s", "__d")


def price_conflicts(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(symbol, day) with closes that differ by more than `tolerance`."""
    return rows.groupBy("symbol", "day").agg((F.max("close") - F.min("close")).alias("spread"), F.count(F.lit(1)).alias("rows")).where(F.col("spread") > tolerance)
