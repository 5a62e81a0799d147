"""Sheets, calibration and lineage on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import hashing, metrics, rules, stats
from quillmark.operators import calibrate, sheets
from quillmark.plans.backtest import RANKED
from quillmark.plans.base import BACKTEST, backtest
from quillmark.plans.registry import query
from quillmark.plans.screening import CRITERIA, NAMES, POLICY, issues
from quillmark.sources.tables import table


@query("r18_gate", BACKTEST + """ SELECT count(*) AS n, count(DISTINCT split_part(stamp, '-', 1)) AS vintages, CASE WHEN count(*) < 30 THEN 'CALIBRATION_INELIGIBLE' WHEN count(*) < 100 OR count(DISTINCT split_part(stamp, '-', 1)) < 3 THEN 'CALIBRATION_EXPLORATORY' ELSE 'CALIBRATION_CANDIDATE' END AS tier FROM backtest""")
def r18_gate(spark, sf_dir):
    return calibrate.gate(backtest(spark, sf_dir).withColumn("year", stats.vintage(F.col("stamp"))), "year")


WEIGHTS = {"module_a": 50.0, "module_c": 30.0, "module_d": 20.0}


@query("r19_proposal", BACKTEST + f""", y AS (SELECT *, split_part(stamp, '-', 1) AS year FROM backtest WHERE return_1w IS NOT NULL), dev AS (SELECT * FROM y WHERE year < (SELECT max(year) FROM y)), held AS (SELECT * FROM y WHERE year = (SELECT max(year) FROM y)),
p AS (UNPIVOT (SELECT evaluation_id, return_1w, module_a, module_c, module_d FROM dev) ON module_a, module_c, module_d INTO NAME module VALUE x),
r AS (SELECT module, {RANKED.format(k='module', c='x')} AS rx, {RANKED.format(k='module', c='return_1w')} AS ry FROM p),
c AS (SELECT module, round(corr(rx, ry), 6) AS correlation, CASE module WHEN 'module_a' THEN 50.0 WHEN 'module_c' THEN 30.0 ELSE 20.0 END AS weight FROM r GROUP BY 1),
t AS (SELECT *, weight + CASE WHEN row_number() OVER (ORDER BY correlation DESC, module DESC) = 1 THEN 5.0 WHEN row_number() OVER (ORDER BY correlation, module) = 1 THEN -5.0 ELSE 0.0 END AS trial FROM c),
h AS (SELECT return_1w, round(coalesce(module_a, 0) / 50 * 50 + coalesce(module_c, 0) / 30 * 30 + coalesce(module_d, 0) / 20 * 20, 2) AS base,
  round(coalesce(module_a, 0) / 50 * (SELECT trial FROM t WHERE module = 'module_a') + coalesce(module_c, 0) / 30 * (SELECT trial FROM t WHERE module = 'module_c') + coalesce(module_d, 0) / 20 * (SELECT trial FROM t WHERE module = 'module_d'), 2) AS tilted FROM held),
k AS (SELECT {RANKED.format(k='1', c='base')} AS rb, {RANKED.format(k='1', c='tilted')} AS rt, {RANKED.format(k='1', c='return_1w')} AS ry FROM h), z AS (SELECT round(corr(rt, ry), 6) < round(corr(rb, ry), 6) - 0.05 AS worse FROM k)
SELECT module, correlation, CAST(CASE WHEN worse THEN weight ELSE trial END AS DOUBLE) AS weight, CASE WHEN worse THEN 'REJECTED' ELSE 'PROPOSED' END AS status FROM t, z""")
def r19_proposal(spark, sf_dir):
    """Weights and status of the tilt, as held against the last vintage."""
    made = calibrate.tilted(backtest(spark, sf_dir).withColumn("year", stats.vintage(F.col("stamp"))), "evaluation_id", WEIGHTS, "return_1w", "year")
    rows = [(m, c, float(made["weights"][m]), made["status"]) for m, c in made["correlations"].items()]
    return spark.createDataFrame(rows, "module string, correlation double, weight double, status string")


@query("p15_config_versions", "SELECT o_orderpriority AS config_version, min(o_orderdate) AS first_used, max(o_orderdate) AS last_used, count(*) AS evaluations FROM orders GROUP BY 1")
def p15_config_versions(spark, sf_dir):
    return sheets.config_versions(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config_version"), F.col("o_orderdate").alias("evaluated_at")))


@query("p18_top_risks", CRITERIA + """, listed AS (""" + " UNION ALL ".join(f"SELECT ipo_id, '{c}' AS criterion, '{k}' AS kind, {c}_points AS points, {na} AS na FROM c" for c, k, na in (("growth", "criterion", "false"), ("trend", "criterion", "false"), ("cash", "criterion", "cfo_pat_na"), ("leverage", "criterion", "false"), ("decline", "penalty", "false"))) + """),
k AS (SELECT *, CASE WHEN kind = 'penalty' AND points < 0 THEN 0 WHEN kind <> 'penalty' AND points = 0 THEN 1 WHEN points IS NULL AND NOT na THEN 2 END AS risk FROM listed)
SELECT ipo_id AS evaluation_id, criterion, risk, row_number() OVER (PARTITION BY ipo_id ORDER BY risk, criterion) AS rank FROM k WHERE risk IS NOT NULL QUALIFY rank <= 3""")
def p18_top_risks(spark, sf_dir):
    scored = rules.criteria(metrics.derive(issues(spark, sf_dir), NAMES), "ipo_id", POLICY).withColumnRenamed("ipo_id", "evaluation_id")
    return sheets.risks(scored).select("evaluation_id", "criterion", "risk", "rank")


@query("p5_module_scores", CRITERIA + """ SELECT ipo_id, 'A' AS module, coalesce(growth_points, 0) + coalesce(trend_points, 0) + coalesce(cash_points, 0) AS score FROM c UNION ALL SELECT ipo_id, 'B', greatest(0, coalesce(leverage_points, 0) + coalesce(decline_points, 0)) FROM c""")
def p5_module_scores(spark, sf_dir):
    return rules.modules(metrics.derive(issues(spark, sf_dir), NAMES), "ipo_id", POLICY).select("ipo_id", "module", "score")


@query("p22_comparison", """WITH a AS (SELECT l_suppkey AS k, CAST(round(sum(l_quantity)) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 GROUP BY 1), b AS (SELECT l_suppkey AS k, CAST(round(sum(l_quantity)) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 3 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after, coalesce(b.v, 0) - coalesce(a.v, 0) AS delta FROM a FULL JOIN b ON a.k = b.k""")
def p22_comparison(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    of = lambda flag, some: li.where((F.col("l_returnflag") == flag) & some).groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity")).alias("v"))
    return sheets.compared(of("A", F.col("l_quantity") > 45), of("R", F.col("l_quantity") < 3), ["k"], "v")


@query("p2_flattened", "SELECT o_orderkey, o_custkey AS issue_ipo_id, o_totalprice AS issue_price_high, o_orderstatus AS market_mode FROM orders")
def p2_flattened(spark, sf_dir):
    nested = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("ipo_id"), F.struct(F.col("o_totalprice").alias("high")).alias("price")).alias("issue"), F.struct(F.col("o_orderstatus").alias("mode")).alias("market"))
    return nested.select(*hashing.flattened(nested.schema))


@query("k4_long_analysis", BACKTEST + f""", r AS (SELECT 'final_score' AS predictor, 'return_1w' AS outcome, {RANKED.format(k='1', c='final_score')} AS rx, {RANKED.format(k='1', c='return_1w')} AS ry FROM backtest WHERE return_1w IS NOT NULL)
SELECT 'CORRELATION' AS section, predictor, outcome, count(*) AS n, round(corr(rx, ry), 6) AS value, 'CALCULATED' AS status FROM r GROUP BY 2, 3
UNION ALL SELECT 'HIT_RATE', NULL, 'return_1w', count(return_1w), round(100.0 * count(*) FILTER (return_1w > 0) / count(return_1w), 6), 'CALCULATED' FROM backtest""")
def k4_long_analysis(spark, sf_dir):
    from quillmark.sources.sinks import long_analysis

    rows = backtest(spark, sf_dir)
    hits = stats.hit_rates(rows.withColumn("outcome", F.lit("return_1w")), ["outcome"], "return_1w").withColumnRenamed("hit_rate", "value")
    return long_analysis({"CORRELATION": stats.correlation_matrix(rows, "evaluation_id", ["final_score"], ["return_1w"]), "HIT_RATE": hits})
