"""Price files: header aliases, cleaning, and refusal of bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import benchmark_symbol, is_benchmark

#: Names under which a column may stand in a file's header, upper case.
ALIASES = {
    "day": ["DATE", "TRADE_DATE", "TRADING_DATE", "TIMESTAMP"],
    "symbol": ["SYMBOL", "TICKER", "SCRIP", "SECURITY"],
    "open": ["OPEN", "OPEN_PRICE"],
    "high": ["HIGH", "HIGH_PRICE"],
    "low": ["LOW", "LOW_PRICE"],
    "close": ["CLOSE", "CLOSE_PRICE", "LAST"],
    "volume": ["VOLUME", "TOTTRDQTY", "QTY"],
    "factor": ["CORPORATE_ACTION_FACTOR", "ADJUSTMENT_FACTOR", "FACTOR"],
}


def _number(column: Column) -> Column:
    return F.regexp_replace(F.trim(column.cast("string")), ",", "").try_cast("double")


def _checked(rows: DataFrame) -> DataFrame:
    """Typed columns; a row that breaks a rule stops the read with its values."""
    have = {c.strip().upper(): c for c in rows.columns}
    raw = {name: next((F.col(f"`{have[a]}`") for a in names if a in have), None) for name, names in ALIASES.items()}
    for needed in ("day", "symbol", "close"):
        if raw[needed] is None:
            raise ValueError(f"the price file has no column for {needed}")
    numbers = {n: F.lit(None).cast("double") if raw[n] is None else _number(raw[n]) for n in ("open", "high", "low", "close", "volume", "factor")}
    day = F.try_to_date(F.split_part(raw["day"].cast("string"), F.lit("T"), F.lit(1)))
    typed = rows.select(F.upper(F.trim(raw["symbol"])).alias("symbol"), day.alias("day"), *[c.alias(n) for n, c in numbers.items()]).withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    negative = F.array_min(F.array("open", "high", "low", "volume")) < 0
    bad = F.col("day").isNull() | F.coalesce(F.col("symbol") == "", F.lit(True)) | F.coalesce(F.col("close") <= 0, F.lit(True)) | F.coalesce(negative, F.lit(False)) | (F.col("factor") <= 0)
    why = F.concat(F.lit("bad price row: "), F.to_json(F.struct("symbol", "day", "open", "high", "low", "close", "volume", "factor")))
    return typed.withColumn("close", F.when(bad, F.raise_error(why).cast("double")).otherwise(F.col("close")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _checked(spark.read.option("header", True).csv(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document with `prices`, or an array of price rows."""
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if "prices" in rows.columns:
        rows = rows.select(F.explode("prices").alias("p")).select("p.*")
    return _checked(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A price file, by its suffix. One close for a symbol and day: closes that differ by more than 1e-6 are an error, of others the last is taken."""
    if path.lower().endswith(".csv"):
        rows = read_csv(spark, path)
    elif path.lower().endswith(".json"):
        rows = read_json(spark, path)
    else:
        raise ValueError(f"no reader for {path}")
    numbered = rows.withColumn("__n", F.monotonically_increasing_id())
    last = numbered.groupBy("symbol", "day").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("symbol", "day")]), "__n").alias("p"), (F.max("close") - F.min("close")).alias("spread"))
    clash = F.when(F.col("spread") > 1e-6, F.raise_error(F.concat(F.lit("conflicting closes for "), "symbol", F.lit(" "), F.col("day").cast("string"))).cast("double")).otherwise(F.col("p.close"))
    return last.select("symbol", "day", clash.alias("close"), *[f"p.{c}" for c in rows.columns if c not in ("symbol", "day", "close")])


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, day, level) of the benchmarks in a price file: price rows of a benchmark's symbol, and a JSON file's `benchmark_prices`, whose levels win.

    An entry without a date or close is passed over, a level of 0 or less is an error.
    """
    rows = read(spark, path)
    found = rows.where(is_benchmark(F.col("symbol"))).select(benchmark_symbol(F.col("symbol")).alias("symbol"), "day", F.col("close").alias("level"), F.lit(0).alias("rank"))
    if path.lower().endswith(".json"):
        raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        if "benchmark_prices" in raw.columns:
            block = raw.select(F.posexplode("benchmark_prices").alias("at", "p")).where("p.date is not null and p.close is not null")
            level = _number(F.col("p.close"))
            checked = F.when(F.coalesce(level <= 0, F.lit(True)), F.raise_error(F.lit("benchmark close must be positive")).cast("double")).otherwise(level)
            found = found.unionByName(block.select(benchmark_symbol(F.coalesce("p.symbol", F.lit("NIFTY_50_TRI"))).alias("symbol"), F.to_date(F.split_part("p.date", F.lit("T"), F.lit(1))).alias("day"), checked.alias("level"), (F.col("at") + 1).alias("rank")))
    return found.groupBy("symbol", "day").agg(F.max_by("level", "rank").alias("level"))
