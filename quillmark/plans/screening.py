"""Screening of issues: metrics, criteria, knockouts, verdicts and their projections.

Customers are issuers: their yearly order totals are revenues, other figures of
a year derive from them, and years without orders or with a status leave gaps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import metrics, rules
from quillmark.operators import validate
from quillmark.plans.base import places
from quillmark.plans.registry import query
from quillmark.sources.tables import table

ISSUES = """
WITH y AS (SELECT o_custkey AS ipo_id, year(o_orderdate) AS fy, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue, count(*) AS n, min(o_orderstatus) AS s FROM orders GROUP BY 1, 2),
p AS (SELECT ipo_id, fy, revenue, CASE WHEN n % 4 <> 3 THEN revenue * (0.1 + (fy % 5) * 0.03) END AS ebitda, revenue * ((n % 6) - 1) * 0.02 AS pat,
             CASE WHEN s <> 'P' THEN revenue * ((fy % 4) - 0.5) * 0.03 END AS cfo, revenue * 0.5 AS net_worth, revenue * (n % 5) * 0.25 AS total_debt, revenue * 0.08 AS ebit, revenue * (n % 3) * 0.01 AS interest_expense,
             row_number() OVER (PARTITION BY ipo_id ORDER BY fy) AS pos, count(*) OVER (PARTITION BY ipo_id) AS years FROM y),
l AS (SELECT ipo_id, years, max(revenue) FILTER (pos = years) AS r0, max(revenue) FILTER (pos = years - 2) AS r2, max(revenue) FILTER (pos = years - 3) AS r3,
             max(pat) FILTER (pos = years) AS p0, max(pat) FILTER (pos = years - 1) AS p1, max(pat) FILTER (pos = years - 2) AS p2, count(cfo) AS ncfo, sum(CAST(round(cfo, 6) AS DECIMAL(30, 6))) AS cfo, sum(CAST(round(pat, 6) AS DECIMAL(30, 6))) AS pat,
             max(net_worth) FILTER (pos = years) AS nw, max(total_debt) FILTER (pos = years) AS debt, max(ebit) FILTER (pos = years) AS ebit, max(interest_expense) FILTER (pos = years) AS interest,
             list(ebitda / revenue * 100 ORDER BY pos) AS em, list(pat / revenue * 100 ORDER BY pos) AS pm FROM p GROUP BY 1, 2),
m AS (SELECT ipo_id, years,
  CASE WHEN r0 > 0 AND r2 > 0 THEN (pow(r0 / r2, 0.5) - 1) * 100 END AS revenue_cagr,
  CASE WHEN p0 > 0 AND p2 > 0 THEN (pow(p0 / p2, 0.5) - 1) * 100 END AS pat_cagr, p0 IS NOT NULL AND p2 IS NOT NULL AND (p0 <= 0 OR p2 <= 0) AS pat_cagr_na,
  CASE WHEN ncfo = years AND pat > 0 THEN CAST(cfo AS DOUBLE) / CAST(pat AS DOUBLE) END AS cfo_pat, ncfo = years AND pat <= 0 AS cfo_pat_na,
  CASE WHEN debt / nw < 0.5 THEN CASE WHEN interest = 0 AND debt = 0 THEN 'strong' WHEN interest > 0 AND ebit / interest > 5 THEN 'strong' WHEN interest > 0 THEN 'ok' END
       WHEN debt / nw < 1 THEN 'ok' WHEN debt / nw <= 2 THEN 'stretched' WHEN debt / nw > 2 THEN 'weak' END AS leverage,
  ebit / (nw + debt) * 100 AS roce,
  CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN (p0 < p1) OR coalesce(CASE WHEN p0 > 0 AND p2 > 0 THEN pow(p0 / p2, 0.5) - 1 END < 0, false) END AS profit_declining,
  CASE WHEN len(list_filter(em, lambda x: x IS NULL)) = 0 AND years >= 2 THEN
    CASE WHEN p0 <= 0 OR (len(list_filter(range(2, years + 1), lambda i: em[i] < em[i - 1] AND pm[i] < pm[i - 1])) = years - 1) THEN 'declining_or_loss'
         WHEN len(list_filter(range(2, years + 1), lambda i: em[i] > em[i - 1] AND pm[i] > pm[i - 1])) = years - 1 THEN 'expanding'
         WHEN len(list_filter(range(2, years + 1), lambda i: em[i] > em[i - 1])) > 0 AND len(list_filter(range(2, years + 1), lambda i: em[i] < em[i - 1])) > 0 AND list_max(em) - list_min(em) > 3 THEN 'volatile'
         ELSE 'stable' END END AS margin_trend FROM l)
"""
NAMES = ["revenue_cagr_2y_from_3fy", "pat_cagr_2y_from_3fy", "cfo_pat_cumulative", "leverage_bucket", "roce_latest", "profit_declining", "margin_trend"]


def issues(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100
    y = o.groupBy(F.col("o_custkey").alias("ipo_id"), F.year("o_orderdate").alias("fy")).agg(cents.alias("revenue"), F.count(F.lit(1)).alias("n"), F.min("o_orderstatus").alias("s"))
    n, r, fy = F.col("n"), F.col("revenue"), F.col("fy")
    figures = {"revenue": r, "ebitda": F.when(n % 4 != 3, r * (0.1 + (fy % 5) * 0.03)), "pat": r * ((n % 6) - 1) * 0.02, "cfo": F.when(F.col("s") != "P", r * ((fy % 4) - 0.5) * 0.03), "net_worth": r * 0.5, "total_debt": r * (n % 5) * 0.25, "ebit": r * 0.08, "interest_expense": r * (n % 3) * 0.01}
    period = F.struct(fy.cast("string").alias("fy"), F.lit(False).alias("is_stub"), *[figures.get(f, F.lit(None)).cast("double").alias(f) for f in metrics.PERIOD_FIELDS])
    return y.groupBy("ipo_id").agg(F.array_sort(F.collect_list(period)).alias("periods"))


@query("metrics_financial", ISSUES + """ SELECT ipo_id, round(revenue_cagr, 4) AS revenue_cagr, round(pat_cagr, 4) AS pat_cagr, round(cfo_pat, 4) AS cfo_pat, leverage, round(roce, 4) AS roce, profit_declining, margin_trend FROM m""")
def metrics_financial(spark, sf_dir):
    d = metrics.derive(issues(spark, sf_dir), NAMES)
    return d.select("ipo_id", F.round("revenue_cagr_2y_from_3fy", 4).alias("revenue_cagr"), F.round("pat_cagr_2y_from_3fy", 4).alias("pat_cagr"), F.round("cfo_pat_cumulative", 4).alias("cfo_pat"), F.col("leverage_bucket").alias("leverage"), F.round("roce_latest", 4).alias("roce"), "profit_declining", "margin_trend")


@query("metrics_states", ISSUES + """ SELECT 'pat_cagr_2y_from_3fy' AS metric_id, CASE WHEN pat_cagr IS NOT NULL THEN 'VALUE' WHEN pat_cagr_na THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END AS state, 'numeric' AS kind, count(*) AS n FROM m GROUP BY 2
UNION ALL SELECT 'cfo_pat_cumulative', CASE WHEN cfo_pat IS NOT NULL THEN 'VALUE' WHEN cfo_pat_na THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END, 'numeric', count(*) FROM m GROUP BY 2
UNION ALL SELECT 'margin_trend', CASE WHEN margin_trend IS NOT NULL THEN 'VALUE' ELSE 'UNKNOWN' END, 'categorical', count(*) FROM m GROUP BY 2""")
def metrics_states(spark, sf_dir):
    names = ["pat_cagr_2y_from_3fy", "cfo_pat_cumulative", "margin_trend"]
    return metrics.long_form(metrics.derive(issues(spark, sf_dir), names), "ipo_id", names).groupBy("metric_id", "state", "kind").agg(F.count(F.lit(1)).alias("n"))


POLICY = {
    "modules": [
        {"id": "A", "criteria": [
            {"id": "growth", "max": 6, "metric": "revenue_cagr_2y_from_3fy", "rule": {"type": "bands", "bands": [[">", 25, 6], [">=", 15, 4], [">=", 0, 2]], "else": 0}},
            {"id": "trend", "max": 5, "metric": "margin_trend", "rule": {"type": "categorical", "map": {"expanding": 5, "stable": 3, "volatile": 1, "declining_or_loss": 0}}},
            {"id": "cash", "max": 5, "metric": "cfo_pat_cumulative", "rule": {"type": "bands", "bands": [[">", 0.8, 5], [">=", 0.5, 3]], "else": 1}},
        ]},
        {"id": "B", "criteria": [
            {"id": "leverage", "max": 4, "metric": "leverage_bucket", "rule": {"type": "categorical", "map": {"strong": 4, "ok": 2, "stretched": 1, "weak": 0}}},
            {"id": "decline", "kind": "penalty", "max": 0, "points": -2, "when": {"flag": "profit_declining"}},
        ]},
    ],
    "penalties": {"max_total": -3, "items": [{"points": -4, "when": {"metric": "roce_latest", "op": "<", "value": 5}}]},
    "caps": [{"max_score": 10, "when": {"metric": "leverage_bucket", "in": ["weak"]}}],
    "knockouts": [{"id": "K1", "required": ["cfo_pat_cumulative"], "when": {"all": [{"metric": "cfo_pat_cumulative", "op": "<", "value": 0}, {"flag": "profit_declining"}]}}],
    "verdict": {"bands": [{"min": 14, "verdict": "APPLY"}, {"min": 8, "verdict": "NEUTRAL"}], "else": "AVOID"},
    "critical_data": {"items": ["leverage_bucket"]},
}
CRITERIA = ISSUES + """, c AS (
  SELECT *, CASE WHEN revenue_cagr > 25 THEN 6.0 WHEN revenue_cagr >= 15 THEN 4 WHEN revenue_cagr >= 0 THEN 2 WHEN revenue_cagr IS NOT NULL THEN 0 END AS growth_points,
    CASE margin_trend WHEN 'expanding' THEN 5.0 WHEN 'stable' THEN 3 WHEN 'volatile' THEN 1 WHEN 'declining_or_loss' THEN 0 END AS trend_points,
    CASE WHEN cfo_pat > 0.8 THEN 5.0 WHEN cfo_pat >= 0.5 THEN 3 WHEN cfo_pat IS NOT NULL THEN 1 END AS cash_points,
    CASE leverage WHEN 'strong' THEN 4.0 WHEN 'ok' THEN 2 WHEN 'stretched' THEN 1 WHEN 'weak' THEN 0 END AS leverage_points,
    CASE WHEN profit_declining THEN -2.0 WHEN NOT profit_declining THEN 0 END AS decline_points FROM m)"""


@query("r1_criteria", CRITERIA + " " + " UNION ALL ".join(f"""SELECT ipo_id, '{m}' AS module, '{c}' AS criterion, CASE WHEN {c}_points IS NOT NULL THEN 'SCORED' WHEN {na} THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END AS state, CAST({c}_points AS DOUBLE) AS points FROM c""" for m, c, na in (("A", "growth", "false"), ("A", "trend", "false"), ("A", "cash", "cfo_pat_na"), ("B", "leverage", "false"), ("B", "decline", "false"))))
def r1_criteria(spark, sf_dir):
    return rules.criteria(metrics.derive(issues(spark, sf_dir), NAMES), "ipo_id", POLICY).select("ipo_id", "module", "criterion", "state", "points")


@query("r4_verdicts", CRITERIA + """, s AS (
  SELECT *, coalesce(growth_points, 0) + coalesce(trend_points, 0) + coalesce(cash_points, 0) + greatest(0, coalesce(leverage_points, 0) + coalesce(decline_points, 0)) AS base,
    CASE WHEN roce < 5 THEN -3.0 ELSE 0 END AS pen, CASE WHEN roce IS NULL THEN 4 ELSE 0 END AS reserve,
    CASE WHEN growth_points IS NULL THEN 6 ELSE 0 END + CASE WHEN trend_points IS NULL THEN 5 ELSE 0 END + CASE WHEN cash_points IS NULL AND NOT cfo_pat_na THEN 5 ELSE 0 END + CASE WHEN leverage_points IS NULL THEN 4 ELSE 0 END AS unknown_points,
    CASE WHEN growth_points IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN trend_points IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN cash_points IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN leverage_points IS NOT NULL THEN 4 ELSE 0 END AS available_points,
    CASE WHEN cfo_pat < 0 AND profit_declining THEN 'TRIGGERED' WHEN (cfo_pat < 0 AND profit_declining) IS NULL OR cfo_pat IS NULL THEN 'UNVERIFIED' ELSE 'CLEAR' END AS knockout_status FROM c),
b AS (SELECT *, least(greatest(0, base + pen), CASE WHEN leverage = 'weak' THEN 10 ELSE 1e9 END) AS final_score, least(greatest(0, base + pen - reserve), CASE WHEN leverage = 'weak' THEN 10 ELSE 1e9 END) AS lower_bound,
  least(greatest(0, base + unknown_points + pen), CASE WHEN leverage = 'weak' THEN 10 ELSE 1e9 END) AS upper_bound FROM s)
SELECT ipo_id, final_score, lower_bound, upper_bound, CAST(unknown_points AS DOUBLE) AS unknown_points, round(CASE WHEN available_points + unknown_points > 0 THEN available_points * 100.0 / (available_points + unknown_points) ELSE 0 END, 4) AS completeness_pct, knockout_status,
  CASE WHEN knockout_status = 'TRIGGERED' THEN 'AVOID' WHEN leverage IS NULL THEN 'INSUFFICIENT_DATA'
       WHEN CASE WHEN lower_bound >= 14 THEN 'APPLY' WHEN lower_bound >= 8 THEN 'NEUTRAL' ELSE 'AVOID' END <> CASE WHEN upper_bound >= 14 THEN 'APPLY' WHEN upper_bound >= 8 THEN 'NEUTRAL' ELSE 'AVOID' END THEN 'VERDICT_UNCERTAIN'
       WHEN final_score >= 14 THEN 'APPLY' WHEN final_score >= 8 THEN 'NEUTRAL' ELSE 'AVOID' END AS verdict FROM b""")
def r4_verdicts(spark, sf_dir):
    done = rules.evaluate(metrics.derive(issues(spark, sf_dir), NAMES), "ipo_id", POLICY)
    return done.select("ipo_id", "final_score", "lower_bound", "upper_bound", "unknown_points", F.round("completeness_pct", 4).alias("completeness_pct"), "knockout_status", "verdict")


@query("f2_kleene", """SELECT o_orderkey, (o_totalprice > 200000 AND (p OR o_custkey % 2 = 0)) AS truth, CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p THEN 'TRUE' ELSE 'FALSE' END AS outcome, coalesce(o_totalprice > 200000, false) AND (coalesce(p, false) OR coalesce(o_custkey % 2 = 0, false)) AS two_valued
FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS p FROM orders)""")
def f2_kleene(spark, sf_dir):
    tree = {"all": [{"metric": "o_totalprice", "op": ">", "value": 200000}, {"any": [{"flag": "p"}, {"metric": "even", "op": "==", "value": 0}]}]}
    o = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")).withColumn("even", F.col("o_custkey") % 2)
    return o.select("o_orderkey", rules.truth(tree, o.columns).alias("truth"), F.get(rules.trace(tree, o.columns), F.lit(1))["outcome"].alias("outcome"), rules.two_valued(tree, o.columns).alias("two_valued"))


@query("m9_bands", "SELECT p_partkey, CASE WHEN p_retailprice > 1000 THEN 6.0 WHEN p_retailprice >= 950 THEN 4.0 WHEN p_size <= -1 THEN 1.0 ELSE 0.5 END AS points FROM part")
def m9_bands(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.banded(F.col("p_retailprice"), {"bands": [[">", 1000, 6], [">=", 950, 4]], "else": 0.5}).alias("points"))


@query("r25_stepwise", """WITH RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, (l_quantity - 25) AS d FROM lineitem),
f AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(10 AS DOUBLE) AS a FROM l UNION ALL SELECT f.k, l.i, greatest(0, least(20, f.a + l.d)) FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1) SELECT k AS o_orderkey, arg_max(a, i) AS scenario FROM f GROUP BY 1""")
def r25_stepwise(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    return li.select("o_orderkey", rules.stepwise(F.lit(10.0), F.transform("lines", lambda x: x["l_quantity"] - 25), 20).alias("scenario"))


@query("r12_findings", """WITH y AS (SELECT o_custkey AS ipo_id, year(o_orderdate) AS fy, sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2), n AS (SELECT ipo_id, count(*) AS years, min(revenue) AS low FROM y GROUP BY 1)
SELECT ipo_id, 'TOO_FEW_PERIODS' AS code, 'ERROR' AS severity FROM n WHERE years < 6 UNION ALL SELECT ipo_id, 'SMALL_REVENUE', 'WARNING' FROM n WHERE low < 20000""")
def r12_findings(spark, sf_dir):
    rows = issues(spark, sf_dir)
    return validate.findings(rows, "ipo_id", {"TOO_FEW_PERIODS": ("ERROR", F.size("periods") < 6), "SMALL_REVENUE": ("WARNING", F.array_min(F.transform("periods", lambda p: p["revenue"])) < 20000)})


@query("w4_margin_deltas", ISSUES + " SELECT ipo_id, fy, floor((ebitda / revenue * 100 - lag(ebitda / revenue * 100) OVER (PARTITION BY ipo_id ORDER BY fy)) * 10000 + 0.5) / 10000 AS delta FROM p")
def w4_margin_deltas(spark, sf_dir):
    from pyspark.sql import Window

    p = issues(spark, sf_dir).select("ipo_id", F.posexplode("periods").alias("pos", "p"))
    margin = F.col("p.ebitda") / F.col("p.revenue") * 100
    return p.select("ipo_id", F.col("p.fy").cast("long").alias("fy"), places(margin - F.lag(margin).over(Window.partitionBy("ipo_id").orderBy("pos")), 4).alias("delta"))
