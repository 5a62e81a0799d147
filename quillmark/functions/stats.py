"""Statistics of backtest tables: ranks, correlations, quantiles, hit rates.

Every function takes a DataFrame and gives one back; groups are always columns,
so that many populations are done in one pass and none is driven by a loop.

What needs an order of all values of a population (ranks, quantiles, medians) cuts
them into cells, numbers the values within each cell, and adds what the cells
before hold; so a population is ordered by many tasks, and few populations are as
well spread as many. Cells follow from the least and greatest value alone, so a
task that is run again finds the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A return this close to 0 counts as zero, beside its sign.
ZERO = 1e-9


#: Cells of equal width between a population's least and greatest value.
CELLS = 1024


def celled(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`df` with cell columns __a, __b that ascend with `value` (a non-null number) within each population.

    Equal widths spread what is spread evenly; sixteenths of powers of two within
    them, what isn't.
    """
    span = df.groupBy(*keys).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    met = df.join(span.select(*[F.col(k).alias(f"__{k}") for k in keys], "__lo", "__hi"), [df[k].eqNullSafe(F.col(f"__{k}")) for k in keys]) if keys else df.crossJoin(F.broadcast(span))
    v = F.col(value).cast("double")
    width = F.when(F.col("__hi") > F.col("__lo"), F.floor((v - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (CELLS - 1))).otherwise(0)
    size = F.signum(v) * (F.floor(F.log2(F.abs(v) + 1e-300) * 16) + 20_000)
    return met.withColumns({"__a": width.cast("long"), "__b": size.cast("long")}).drop("__lo", "__hi", *[f"__{k}" for k in keys])


def counted_up(rows: DataFrame, keys: list[str], value: str, weight: str, order: list[Column]) -> DataFrame:
    """`rows` with `upto`, the sum of `weight` up to and with the row in the order (which begins with `value`), and `all`, the population's sum."""
    cells = celled(rows, keys, value)
    inner = Window.partitionBy(*keys, "__a", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.groupBy(*keys, "__a", "__b").agg(F.sum(weight).alias("__sum"))
    # A population has some thousands of cells at most.
    before = Window.partitionBy(*keys).orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__a").alias("__c"), F.col("__b").alias("__d"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(Window.partitionBy(*keys)).alias("all"))
    own = cells.withColumn("__own", F.sum(weight).over(inner))
    same = [own[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = own.join(sums, [*same, F.col("__a") == F.col("__c"), F.col("__b") == F.col("__d")])
    return met.withColumn("upto", F.col("__own") + F.col("__before")).drop("__own", "__before", "__a", "__b", "__c", "__d", *[f"__{k}" for k in keys])


def steps(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, c, upto, all): the distinct values of each population in order, how often each occurs, how many rows there are up to it, and in all."""
    there = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return counted_up(there, keys, "v", "c", [F.col("v")])


def element(place: Column) -> Column:
    """Aggregate over `steps`: the value at a 0-based place of the sorted values."""
    return F.min(F.when(F.col("upto") > place, F.col("v")))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """`df` without rows of a null value, with the value's rank in its population; equal values (after rounding to 12 places) share the mean of their ranks."""
    rows = df.where(F.col(value).isNotNull()).withColumn("__v", F.round(F.col(value).cast("double"), 12))
    made = steps(rows, keys, "__v").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("v").alias("__w"), (F.col("upto") - (F.col("c") - 1) / 2.0).alias(out))
    return rows.join(made, [*[rows[k].eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__v") == F.col("__w")]).drop("__v", "__w", *[f"__{k}" for k in keys])


def rank_correlation(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman's coefficient for each key: n, value, status.

    Rows with a null on either side are left out for that pair only, and ranks
    are made anew. Under 3 rows the value is null, without variance 0. Equal
    pairs are counted first, and only the distinct ones meet their ranks.
    """
    rounded = lambda c: F.round(F.col(c).cast("double"), 12)
    joint = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, rounded(x).alias("x"), rounded(y).alias("y")).agg(F.count(F.lit(1)).alias("w"))

    def centred(side: str) -> DataFrame:
        """Each value's average rank, less the mean of all ranks."""
        values = joint.groupBy(*keys, F.col(side).alias("v")).agg(F.sum("w").alias("c"))
        ranks = counted_up(values, keys, "v", "c", [F.col("v")])
        return ranks.select(*keys, F.col("v").alias(side), (F.col("upto") - (F.col("c") - 1) / 2.0 - (F.col("all") + 1) / 2.0).alias(f"r{side}"))

    def met(left: DataFrame, side: str) -> DataFrame:
        right = centred(side).withColumnsRenamed({c: f"__{c}" for c in [*keys, side]})
        return left.join(right, [*[left[k].eqNullSafe(F.col(f"__{k}")) for k in keys], left[side] == F.col(f"__{side}")]).drop(f"__{side}", *[f"__{k}" for k in keys])

    ready = met(met(joint, "x"), "y")
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = ready.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(w * rx * rx).alias("vx"), F.sum(w * ry * ry).alias("vy"), F.sum(w * rx * ry).alias("cxy"))
    flat = (F.col("vx") <= 0) | (F.col("vy") <= 0)
    value = F.when(F.col("n") < 3, F.lit(None)).when(flat, 0.0).otherwise(F.round(F.col("cxy") / F.sqrt(F.col("vx")) / F.sqrt(F.col("vy")), 6))
    status = F.when(F.col("n") < 3, "INSUFFICIENT_DATA").when(flat, "UNDEFINED_ZERO_VARIANCE").otherwise("CALCULATED")
    return sums.select(*keys, "n", value.cast("double").alias("value"), status.alias("status"))


def correlation_matrix(df: DataFrame, row: str, predictors: list[str], outcomes: list[str]) -> DataFrame:
    """Spearman's coefficient of each predictor with each outcome. `row` names a row's key columns' struct or id."""
    long = df.unpivot([row, *outcomes], predictors, "predictor", "x").unpivot([row, "predictor", "x"], outcomes, "outcome", "y")
    return rank_correlation(long, ["predictor", "outcome"], "x", "y")


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, min, max, std (0 for one row), q1, q3 and sign counts of the non-null values of each key.

    Median and quartiles are taken from exact counts of the distinct values in
    order, so no list of a key's values is gathered; q1 and q3 are elements of
    the sorted values.
    """
    there = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    places = steps(there, keys, "v").withColumns({"__q1": F.floor(0.25 * (F.col("all") - 1)), "__q3": F.floor(0.75 * (F.col("all") - 1)), "__lo": F.floor((F.col("all") - 1) / 2), "__hi": F.floor(F.col("all") / 2)})
    quartiles = places.groupBy(*keys).agg(F.round((element(F.col("__lo")) + element(F.col("__hi"))) / 2, 6).alias("median"), element(F.col("__q1")).alias("q1"), element(F.col("__q3")).alias("q3"))
    v = F.col("v")
    plain = there.groupBy(*keys).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.count_if(F.abs(v) <= ZERO).alias("zero"),
        F.round(100.0 * F.count_if(v > 0) / F.count(v), 6).alias("positive_rate"),
    )
    quartiles = quartiles.withColumnsRenamed({k: f"__{k}" for k in keys})
    return plain.join(quartiles, [plain[k].eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])


def hit_rates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """hits (value > 0), misses, rate in percent, status: NO_DATA where a key has no value."""
    n, hits = F.count(value), F.count_if(F.col(value) > 0)
    return df.groupBy(*keys).agg(n.alias("n"), hits.alias("hits"), (n - hits).alias("misses"), F.round(F.try_divide(100.0 * hits, n), 6).alias("hit_rate"), F.when(n == 0, "NO_DATA").otherwise("CALCULATED").alias("status"))


def floor_quantiles(df: DataFrame, partition: list[str], order: list[Column], buckets: int, by: str) -> DataFrame:
    """`df` with `bucket` 1..buckets: bucket b has the rows from floor(b*n/N) up to floor((b+1)*n/N) of the order, which begins with the number `by`.

    Partitions with fewer rows than buckets get a null bucket, rows without `by`
    come first. Each partition is one population; rows of one value of `by` are
    ordered by one task.
    """
    lowest = -1.7e308
    rows = df.withColumns({"__by": F.coalesce(F.col(by).cast("double"), F.lit(lowest)), "__one": F.lit(1)})
    placed = counted_up(rows, partition, "__by", "__one", order)
    return placed.withColumn("bucket", F.when(F.col("all") >= buckets, (F.floor((F.col("upto") * buckets - 1) / F.col("all")) + 1).cast("int"))).drop("__by", "__one", "upto", "all")


def upper_medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): of each key's sorted non-null values, the one at n // 2."""
    return steps(df, keys, value).groupBy(*keys).agg(element(F.floor(F.col("all") / 2)).alias(out))


def maturity(n: Column) -> Column:
    """How far a sample of n rows carries."""
    return F.when(n < 30, "DESCRIPTIVE_ONLY").when(n < 100, "EXPLORATORY").otherwise("STATISTICALLY_ACTIONABLE_FOR_DIAGNOSTICS")


def vintage(stamp: Column) -> Column:
    """Year of an ISO timestamp's text: what is before the first dash, else UNKNOWN."""
    year = F.split_part(F.coalesce(stamp, F.lit("")), F.lit("-"), F.lit(1))
    return F.when(year == "", "UNKNOWN").otherwise(year)


def holdout_split(df: DataFrame, year: str, least: int = 30) -> DataFrame:
    """`df` with `is_holdout`: the last vintage against the rest; null unless there are two vintages and `least` rows in all."""
    facts = df.agg(F.max(year).alias("__last"), F.min(year).alias("__first"), F.count(F.lit(1)).alias("__all"))
    usable = (F.col("__last") > F.col("__first")) & (F.col("__all") >= least)
    return df.join(F.broadcast(facts)).withColumn("is_holdout", F.when(usable, F.col(year) == F.col("__last"))).drop("__last", "__first", "__all")
