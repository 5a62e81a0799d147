"""Post-listing observations: prices of the listing and the observed day, returns, and the benchmark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import returns
from quillmark.operators import asof

#: A benchmark, and the one that stands in where it has no level on the listing day.
FALLBACK = {"NIFTY_50_TRI": "NIFTY_50"}


def build(listings: DataFrame, prices: DataFrame, levels: DataFrame) -> DataFrame:
    """An observation for each row of `listings`.

    listings: evaluation_id, symbol, horizon, issue_price, listed (date), factor
    (the caller's), unverified, benchmark. prices: symbol, day, open, close,
    factor. levels: symbol, day, level.

    The observed day is the last trading day of any symbol at or before the
    target. Returns count from the issue price, secondary ones from the opening
    price. A benchmark without a level on the listing day gives way to its
    fallback, which then is read on the observed day too. An unverified
    corporate action makes the observation UNVERIFIED, a missing observed close
    INCOMPLETE. An issue price of 0 or less is an error.
    """
    days = prices.select("day").unionByName(levels.select("day"))
    checked = F.when(F.col("issue_price") <= 0, F.raise_error(F.lit("issue price must be positive")).cast("double")).otherwise(F.col("issue_price"))
    rows = listings.withColumn("issue_price", checked).withColumn("target", returns.target_date(F.col("listed"), F.col("horizon")))
    rows = asof.resolve_dates(rows, days, "target", "day", "observed")

    def on(rows: DataFrame, table: DataFrame, symbol: str, day: str, columns: dict[str, str]) -> DataFrame:
        side = table.select(F.col("symbol").alias("__s"), F.col("day").alias("__d"), *[F.col(a).alias(b) for a, b in columns.items()])
        return rows.join(side, (rows[symbol] == side["__s"]) & (rows[day] == side["__d"]), "left").drop("__s", "__d")

    rows = on(rows, prices, "symbol", "listed", {"open": "listing_open", "close": "listing_close"})
    rows = on(rows, prices, "symbol", "observed", {"close": "raw_close", "factor": "__recorded"})
    stand_in = F.create_map(*[F.lit(x) for kv in FALLBACK.items() for x in kv])
    rows = rows.withColumn("__other", F.try_element_at(stand_in, F.col("benchmark")))
    rows = on(rows, levels, "benchmark", "listed", {"level": "__first"})
    rows = on(rows, levels, "__other", "listed", {"level": "__first_other"})
    use_other = F.col("__first").isNull() & F.col("__first_other").isNotNull()
    rows = rows.withColumn("benchmark", F.when(use_other, F.col("__other")).otherwise(F.col("benchmark"))).withColumn("listing_level", F.coalesce("__first", "__first_other"))
    rows = on(rows, levels, "benchmark", "observed", {"level": "observed_level"})
    rows = rows.withColumn("factor", returns.effective_factor(F.coalesce("__recorded", F.lit(1.0)), F.col("factor"))).drop("__recorded", "__other", "__first", "__first_other")
    rows = rows.withColumn("adjusted_close", returns.adjusted_close(F.col("raw_close"), F.col("factor")))
    rows = rows.withColumns({
        "listing_gain": returns.listing_gain(F.col("listing_open"), F.col("issue_price")), "absolute_return": returns.simple_return(F.col("adjusted_close"), F.col("issue_price")),
        "secondary_return": returns.simple_return(F.col("adjusted_close"), F.col("listing_open")), "benchmark_return": returns.simple_return(F.col("observed_level"), F.col("listing_level")),
    })
    rows = rows.withColumn("excess_return", returns.excess(F.col("absolute_return"), F.col("benchmark_return")))
    verification = F.when(F.col("unverified"), "UNVERIFIED").when(F.col("factor") != 1.0, "VERIFIED").otherwise("UNADJUSTED")
    return rows.withColumn("verification_status", verification).withColumn("observation_status", F.when(F.col("raw_close").isNull(), "INCOMPLETE").when(F.col("unverified"), "UNVERIFIED").otherwise("VERIFIED"))
