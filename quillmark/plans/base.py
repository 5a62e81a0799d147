"""Relations of the backtest bound to the driver's tables, each with its SQL.

orders are evaluations (mode, score, verdict, time), lineitem gives an order's
module measures and, by line number, its returns over three horizons; a missing
horizon is null. Prices are the daily volume-weighted closes of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.tables import table

PREDICTORS = ["final_score", "module_a", "module_b", "module_c", "module_d", "module_e", "module_f"]
OUTCOMES = ["listing_gain", "return_1w", "return_1m", "return_6m", "excess_1w", "excess_1m", "excess_6m"]
HORIZON = {0: "1w", 1: "1m", 2: "6m"}


def places(value: Column, n: int) -> Column:
    """Rounded by the same steps as the SQL beside it, so that halves agree in both engines."""
    return F.floor(value * float(10**n) + 0.5) / float(10**n)


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("evaluation_id"), F.col("o_custkey").alias("ipo_id"), F.col("o_orderdate").alias("evaluated_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"),
        F.col("o_totalprice").alias("final_score"), F.col("o_orderpriority").alias("verdict"), F.when(F.col("o_orderstatus") == "F", "FINAL").when(F.col("o_orderstatus") == "O", "PRELIMINARY").otherwise("ARCHIVED").alias("mode"),
    )


EVALUATIONS = """
evaluations AS (
  SELECT o_orderkey AS evaluation_id, o_custkey AS ipo_id, o_orderdate AS evaluated_at, strftime(o_orderdate, '%Y-%m-%d') AS stamp,
         o_totalprice AS final_score, o_orderpriority AS verdict,
         CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'PRELIMINARY' ELSE 'ARCHIVED' END AS mode
  FROM orders)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation: module measures and returns, benchmark and excess by horizon, to 6 places."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    mean = lambda c: F.round(F.avg(c), 6)
    by = []
    for h, name in HORIZON.items():
        here = F.col("l_linenumber") % 3 == h
        by.append(mean(F.when(here, F.round(F.col("l_discount") * 100 - 5, 2))).alias(f"return_{name}"))
        by.append(mean(F.when(here, F.round(F.col("l_tax") * 100 - 4, 2))).alias(f"benchmark_{name}"))
    out = li.groupBy(F.col("l_orderkey").alias("evaluation_id")).agg(mean("l_quantity").alias("module_a"), mean("l_extendedprice").alias("module_b"), mean("l_discount").alias("module_c"), mean("l_tax").alias("module_d"), mean("l_suppkey").alias("module_e"), mean("l_partkey").alias("module_f"), F.round(F.max(F.when(F.col("l_linenumber") == 1, F.round(F.col("l_discount") * 100 - 4, 2))), 6).alias("listing_gain"), *by)
    return out.select("*", *[F.round(F.col(f"return_{n}") - F.col(f"benchmark_{n}"), 6).alias(f"excess_{n}") for n in HORIZON.values()])


MEASURES = """
lines AS (
  SELECT l_orderkey AS evaluation_id, round(avg(l_quantity), 6) AS module_a, round(avg(l_extendedprice), 6) AS module_b,
         round(avg(l_discount), 6) AS module_c, round(avg(l_tax), 6) AS module_d, round(avg(l_suppkey), 6) AS module_e, round(avg(l_partkey), 6) AS module_f,
         max(round(l_discount * 100 - 4, 2)) FILTER (l_linenumber = 1) AS listing_gain,
         round(avg(round(l_discount * 100 - 5, 2)) FILTER (l_linenumber % 3 = 0), 6) AS return_1w,
         round(avg(round(l_tax * 100 - 4, 2)) FILTER (l_linenumber % 3 = 0), 6) AS benchmark_1w,
         round(avg(round(l_discount * 100 - 5, 2)) FILTER (l_linenumber % 3 = 1), 6) AS return_1m,
         round(avg(round(l_tax * 100 - 4, 2)) FILTER (l_linenumber % 3 = 1), 6) AS benchmark_1m,
         round(avg(round(l_discount * 100 - 5, 2)) FILTER (l_linenumber % 3 = 2), 6) AS return_6m,
         round(avg(round(l_tax * 100 - 4, 2)) FILTER (l_linenumber % 3 = 2), 6) AS benchmark_6m
  FROM lineitem GROUP BY 1),
measures AS (
  SELECT *, round(return_1w - benchmark_1w, 6) AS excess_1w, round(return_1m - benchmark_1m, 6) AS excess_1m,
         round(return_6m - benchmark_6m, 6) AS excess_6m FROM lines)"""


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final evaluations with their measures; a row for each."""
    final = evaluations(spark, sf_dir).where("mode = 'FINAL'")
    return final.join(measures(spark, sf_dir), "evaluation_id", "left")


BACKTEST = f"""
WITH {EVALUATIONS.strip()}, {MEASURES.strip()},
backtest AS (SELECT * FROM (SELECT * FROM evaluations WHERE mode = 'FINAL') LEFT JOIN measures USING (evaluation_id))
"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return li.groupBy(F.col("l_partkey").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(places(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("close"))


PRICES = """
prices AS (
  SELECT l_partkey AS symbol, CAST(l_shipdate AS DATE) AS day, floor(sum(l_extendedprice) / sum(l_quantity) * 10000 + 0.5) / 10000 AS close
  FROM lineitem GROUP BY 1, 2)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned observations: an order's lines, by horizon; each version but the first supersedes the one before in its horizon."""
    li = table(spark, sf_dir, "lineitem")
    horizon = F.element_at(F.array(F.lit("1W"), F.lit("1M"), F.lit("6M")), F.col("version") % 3 + 1)
    return li.groupBy(F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").alias("version")).agg(F.min("l_partkey").alias("symbol"), F.to_date(F.min("l_shipdate")).alias("observed_on"), F.max(F.round(F.col("l_discount") * 100 - 5, 2)).alias("return_pct")).select(
        "evaluation_id", horizon.alias("horizon"), "version", (F.col("evaluation_id") * 10 + F.col("version")).alias("observation_id"), "symbol", "observed_on", "return_pct", F.when(F.col("version") > 3, F.col("evaluation_id") * 10 + F.col("version") - 3).alias("supersedes"),
    )


OBSERVATIONS = """
observations AS (
  SELECT l_orderkey AS evaluation_id, CASE l_linenumber % 3 WHEN 0 THEN '1W' WHEN 1 THEN '1M' ELSE '6M' END AS horizon, l_linenumber AS version,
         l_orderkey * 10 + l_linenumber AS observation_id, min(l_partkey) AS symbol, CAST(min(l_shipdate) AS DATE) AS observed_on,
         max(round(l_discount * 100 - 5, 2)) AS return_pct,
         CASE WHEN l_linenumber > 3 THEN l_orderkey * 10 + l_linenumber - 3 END AS supersedes
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
