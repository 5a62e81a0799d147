"""Report sheets, overlays and small functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import freshness, metrics, returns, rules
from quillmark.operators import sheets
from quillmark.plans.base import places
from quillmark.plans.measures import RICH, issuers
from quillmark.plans.registry import query
from quillmark.sources import documents
from quillmark.sources.tables import table


def workbook_rows(spark, sf_dir):
    """Orders as evaluations, with arrays from their lines."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("string")
    named = lambda p: F.concat(F.lit(p), n)
    horizon = F.element_at(F.array(F.lit("1W"), F.lit("1M"), F.lit("6M")), F.col("l_linenumber"))
    ordered = lambda s: F.array_sort(F.collect_list(s))
    # Lines of one number and part come as they are stored; how rows are read and shuffled may differ from run to run.
    stored = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    arrays = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        ordered(F.struct(named("c").alias("criterion"), F.when(F.col("l_returnflag") == "R", "UNKNOWN").otherwise("SCORED").alias("state"), F.col("l_quantity").alias("points"))).alias("criteria"),
        ordered(F.struct(named("k").alias("id"), F.when(F.col("l_linestatus") == "O", "UNVERIFIED").otherwise("CLEAR").alias("status"))).alias("knockouts"),
        ordered(F.struct(named("x").alias("id"), F.when(F.col("l_discount") == 0, "UNKNOWN").otherwise("APPLIED").alias("state"), F.col("l_discount").alias("points"))).alias("penalties"),
        ordered(F.struct(F.concat(F.lit("p"), "l_partkey").alias("name"), F.when(F.col("l_tax") == 0, "STALE").otherwise("VALID").alias("status"))).alias("peers"),
        ordered(F.struct(named("b").alias("block"), F.when(F.col("l_quantity") < 5, "STALE").otherwise("FRESH").alias("status"))).alias("blocks"),
        ordered(F.struct(F.col("l_suppkey").alias("source_id"), named("path.").alias("path"))).alias("evidence"),
        ordered(F.when(F.col("l_linenumber") <= 3, F.struct(F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("p"), *stored, horizon.alias("horizon"), F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("listing_gain"), F.col("l_tax").alias("absolute_return"), (F.col("l_discount") - 0.02).alias("benchmark_return")))).alias("observations"),
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ipo_id"), F.concat(F.lit("company"), "o_custkey").alias("company_name"), F.col("o_orderkey").alias("evaluation_id"), F.col("o_orderdate").alias("evaluated_at"), F.when(F.col("o_orderstatus") == "F", "FINAL").otherwise("PRELIMINARY").alias("mode"), F.col("o_orderpriority").alias("config_version"), F.col("o_totalprice").alias("final_score"), F.col("o_orderpriority").alias("verdict"))
    module = F.struct(F.lit("A").alias("module"), F.col("criteria").alias("criteria"))
    return o.join(arrays, F.col("evaluation_id") == F.col("k")).drop("k").withColumn("modules", F.array(module))


SHEET = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
IDS = "o_custkey AS ipo_id, o_orderkey AS evaluation_id"


@query("p3_master", "SELECT o_custkey AS ipo_id, 'company' || o_custkey AS company_name, o_orderkey AS evaluation_id, CASE o_orderstatus WHEN 'F' THEN 'FINAL' ELSE 'PRELIMINARY' END AS mode, o_totalprice AS final_score, o_orderpriority AS verdict FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def p3_master(spark, sf_dir):
    return sheets.master(workbook_rows(spark, sf_dir))


@query("p4_evaluations", f"SELECT DISTINCT {IDS}, 'company' || o_custkey AS company_name, o_orderpriority AS verdict {SHEET}")
def p4_evaluations(spark, sf_dir):
    rows = workbook_rows(spark, sf_dir)
    return sheets.workbook(rows, _sources(spark, sf_dir))["Evaluations"].select("ipo_id", "evaluation_id", "company_name", "verdict")


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))


@query("p6_criteria_detail", f"SELECT {IDS}, 'A' AS module, 'c' || l_linenumber AS criterion, CASE l_returnflag WHEN 'R' THEN 'UNKNOWN' ELSE 'SCORED' END AS state, l_quantity AS points {SHEET}")
def p6_criteria_detail(spark, sf_dir):
    return sheets.criteria_detail(workbook_rows(spark, sf_dir))


@query("p7_knockouts", f"SELECT {IDS}, 'k' || l_linenumber AS id, CASE l_linestatus WHEN 'O' THEN 'UNVERIFIED' ELSE 'CLEAR' END AS status {SHEET}")
def p7_knockouts(spark, sf_dir):
    return sheets.workbook(workbook_rows(spark, sf_dir), _sources(spark, sf_dir))["Knockouts"]


@query("p8_penalties", f"SELECT {IDS}, 'x' || l_linenumber AS id, CASE WHEN l_discount = 0 THEN 'UNKNOWN' ELSE 'APPLIED' END AS state, l_discount AS points {SHEET}")
def p8_penalties(spark, sf_dir):
    return sheets.workbook(workbook_rows(spark, sf_dir), _sources(spark, sf_dir))["Penalties"]


@query("p9_missing", f"""SELECT {IDS}, 'criterion' AS kind, 'c' || l_linenumber AS item, 'UNKNOWN' AS status {SHEET} WHERE l_returnflag = 'R' UNION ALL SELECT {IDS}, 'knockout', 'k' || l_linenumber, 'UNVERIFIED' {SHEET} WHERE l_linestatus = 'O'
UNION ALL SELECT {IDS}, 'peer', 'p' || l_partkey, 'STALE' {SHEET} WHERE l_tax = 0 UNION ALL SELECT {IDS}, 'market', 'b' || l_linenumber, 'STALE' {SHEET} WHERE l_quantity < 5 UNION ALL SELECT {IDS}, 'penalty', 'x' || l_linenumber, 'UNKNOWN' {SHEET} WHERE l_discount = 0""")
def p9_missing(spark, sf_dir):
    return sheets.missing(workbook_rows(spark, sf_dir))


@query("p10_evidence", f"SELECT {IDS}, l_suppkey AS source_id, 'path.' || l_linenumber AS path, s_name AS source_name {SHEET} LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def p10_evidence(spark, sf_dir):
    return sheets.evidence(workbook_rows(spark, sf_dir), _sources(spark, sf_dir))


@query("p11_market_snapshots", f"SELECT {IDS}, 'b' || l_linenumber AS block, CASE WHEN l_quantity < 5 THEN 'STALE' ELSE 'FRESH' END AS status {SHEET}")
def p11_market_snapshots(spark, sf_dir):
    return sheets.workbook(workbook_rows(spark, sf_dir), _sources(spark, sf_dir))["Market_Snapshots"]


@query("p12_peer_snapshots", f"SELECT {IDS}, 'p' || l_partkey AS name, CASE WHEN l_tax = 0 THEN 'STALE' ELSE 'VALID' END AS status {SHEET}")
def p12_peer_snapshots(spark, sf_dir):
    return sheets.workbook(workbook_rows(spark, sf_dir), _sources(spark, sf_dir))["Peer_Snapshots"]


@query("p13_post_listing", f"WITH o AS (SELECT {IDS}, CASE WHEN l_linenumber <= 3 AND l_discount > 0.03 THEN l_discount END AS g, CASE WHEN l_linenumber <= 3 THEN l_tax END AS a, l_linenumber AS at_, l_partkey AS p {SHEET}) SELECT ipo_id, evaluation_id, arg_min(g, (at_, p)) FILTER (g IS NOT NULL) AS listing_gain, arg_min(a, (at_, p)) FILTER (a IS NOT NULL) AS absolute_return FROM o GROUP BY 1, 2")
def p13_post_listing(spark, sf_dir):
    return sheets.post_listing(workbook_rows(spark, sf_dir))


@query("p14_backtest", f"WITH f AS (SELECT {IDS}, o_totalprice AS final_score, o_orderpriority AS verdict, arg_min(l_tax, l_partkey) FILTER (l_linenumber = 3) AS return_6m, arg_min(l_discount - 0.02, l_partkey) FILTER (l_linenumber = 3) AS index_6m {SHEET} WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3, 4) SELECT *, round(return_6m - index_6m, 6) AS excess_6m FROM f")
def p14_backtest(spark, sf_dir):
    return sheets.backtest(workbook_rows(spark, sf_dir))


@query("p16_run_log", f"SELECT DISTINCT {IDS}, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'FINAL' ELSE 'PRELIMINARY' END AS mode {SHEET}")
def p16_run_log(spark, sf_dir):
    log = sheets.workbook(workbook_rows(spark, sf_dir), _sources(spark, sf_dir))["Run_Log"]
    return log.select("ipo_id", "evaluation_id", F.to_date("evaluated_at").alias("day"), "mode")


OVERLAYS = {
    "modules": [
        {"id": "B", "max": 5, "criteria": [{"id": "demand", "max": 5, "metric": "overall_x", "rule": {"type": "bands", "bands": [[">", 5, 5], [">=", 2, 3]], "else": 0}}]},
        {"id": "D", "max": 4, "criteria": [{"id": "pledge", "max": 4, "metric": "promoter_pledge_pct", "rule": {"type": "bands", "bands": [["<", 10, 4], ["<", 40, 2]], "else": 0}}]},
    ],
    "verdict": {"bands": [{"min": 6, "verdict": "APPLY"}], "else": "AVOID"},
    "profile_resolution": {"auto_rules": [{"when": {"metric": "net_debt_bucket", "op": "==", "value": "weak"}, "profile": "LEVERED", "unless_profile": ["PLAIN"]}]},
    "sector_overlays": {"LEVERED": {"remove": ["pledge"], "add": {"D": [{"id": "runway", "max": 4, "metric": "rpt_pct_revenue", "rule": {"type": "bands", "bands": [["<", 20, 4]], "else": 1}}]}}},
    "structure_overlays": {"retail_heavy": {"when": {"metric": "qib_quota_pct", "op": "<", "value": 30}, "override": {"demand": {"metric": "top5_concentration_pct"}}}},
}
OVERLAY_METRICS = ["overall_x", "promoter_pledge_pct", "net_debt_bucket", "rpt_pct_revenue", "qib_quota_pct", "top5_concentration_pct"]


@query("r5_overlays", RICH + """, m AS (SELECT *, CASE WHEN subscription_fresh THEN overall_x END AS ox, greatest(top5_customer_pct, top5_supplier_pct) AS tc, coalesce(years >= 2 AND net_worth > 0 AND (total_debt - cash_and_equivalents) / net_worth > 2 AND NOT coalesce(net_worth_1 > 0 AND (total_debt - cash_and_equivalents) / net_worth < (total_debt_1 - cash_and_equivalents_1) / net_worth_1, false), false) AS levered, coalesce(qib_quota_pct < 30, false) AS heavy FROM d),
s AS (SELECT *, CASE WHEN heavy THEN tc ELSE ox END AS dv, CASE WHEN levered THEN rpt_pct_revenue ELSE promoter_pledge_pct END AS pv FROM m),
t AS (SELECT *, CASE WHEN dv > 5 THEN 5 WHEN dv >= 2 THEN 3 WHEN dv IS NOT NULL THEN 0 END AS b, CASE WHEN levered THEN CASE WHEN pv < 20 THEN 4 WHEN pv IS NOT NULL THEN 1 END ELSE CASE WHEN pv < 10 THEN 4 WHEN pv < 40 THEN 2 WHEN pv IS NOT NULL THEN 0 END END AS p FROM s)
SELECT ipo_id, CASE WHEN levered THEN 'LEVERED' ELSE 'STANDARD' END AS profile, CASE WHEN heavy THEN 'retail_heavy' ELSE '' END AS structures, CAST(coalesce(b, 0) + coalesce(p, 0) AS DOUBLE) AS final_score, CAST(coalesce(b, 5) + coalesce(p, 4) AS DOUBLE) AS upper_bound,
  CASE WHEN (coalesce(b, 0) + coalesce(p, 0) >= 6) <> (coalesce(b, 5) + coalesce(p, 4) >= 6) THEN 'VERDICT_UNCERTAIN' WHEN coalesce(b, 0) + coalesce(p, 0) >= 6 THEN 'APPLY' ELSE 'AVOID' END AS verdict FROM t""")
def r5_overlays(spark, sf_dir):
    made = rules.evaluate_planned(metrics.derive(issuers(spark, sf_dir), OVERLAY_METRICS), "ipo_id", OVERLAYS, total=9)
    return made.select("ipo_id", "profile", "structures", "final_score", "upper_bound", "verdict")


@query("d1_iso_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 3 <> 0 AS has_offset FROM orders")
def d1_iso_dates(spark, sf_dir):
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 == 0, "T10:00:00").when(F.col("o_orderkey") % 3 == 1, "T10:00:00+05:30").otherwise("T04:30:00Z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", returns.iso_date(stamp).alias("day"), returns.has_offset(stamp).alias("has_offset"))


@query("m7_factors", """SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 <> 1 AND p_partkey % 2 = 0 THEN CASE p_partkey % 3 WHEN 0 THEN 0.5 ELSE 2.0 END ELSE CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 3.0 END END AS DOUBLE) AS factor, CASE WHEN p_size > 10 THEN floor((p_retailprice - (p_size - 10)) / (p_size - 10) * 100 * 1e4 + 0.5) / 1e4 END AS secondary_return, CASE WHEN p_size <> 10 THEN floor((p_retailprice - (p_size - 10)) * 100 / (p_size - 10) * 1e4 + 0.5) / 1e4 END AS premium FROM part""")
def m7_factors(spark, sf_dir):
    """Factors of a record and of the caller; returns from an opening price, and premiums over a median, of which some are 0."""
    k, start = F.col("p_partkey"), (F.col("p_size") - 10).cast("double")
    recorded = F.when(k % 3 == 0, 0.5).when(k % 3 == 2, 2.0).otherwise(1.0)
    factor = returns.effective_factor(recorded, F.when(k % 2 == 0, 1.0).otherwise(3.0))
    return table(spark, sf_dir, "part").select("p_partkey", factor.alias("factor"), places(returns.simple_return(F.col("p_retailprice"), start), 4).alias("secondary_return"), places(returns.premium(F.col("p_retailprice"), start), 4).alias("premium"))


@query("r8_cutoffs", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'STALE' WHEN ts > TIMESTAMP '2024-01-10 00:00:00' THEN 'STALE' ELSE 'FRESH' END AS status FROM events")
def r8_cutoffs(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "STALE").otherwise("FRESH")
    return table(spark, sf_dir, "events").select("event_id", freshness.cut_off(status, F.col("ts"), F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("status"))


@query("s11_regimes", "SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'supportive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'weak' WHEN 3 THEN 'supportive' END AS regime, CASE WHEN s_acctbal > 0 THEN round(s_acctbal * 100 / 500, 4) END AS gmp_pct, 'reputed' AS anchor_quality FROM supplier")
def s11_regimes(spark, sf_dir):
    """Captured payloads of three connectors: trends by their synonyms, premiums from money and price, anchors."""
    s = table(spark, sf_dir, "supplier")
    trend = F.element_at(F.array(*[F.lit(x) for x in (" Bullish", "sideways", "DOWN", "up ", "unclear")]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    payload = F.to_json(F.struct(trend.alias("trend"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("gmp"), F.lit(500).alias("price"), F.lit("reputed").alias("quality")))
    rows = documents.grey_market(s.select("s_suppkey", payload.alias("payload")))
    anchors = documents.anchors(rows, "s_suppkey").select(F.col("s_suppkey").alias("a"), "anchor_quality")
    return rows.join(anchors, F.col("a") == F.col("s_suppkey")).select("s_suppkey", documents.market_regime(F.get_json_object("payload", "$.trend")).alias("regime"), F.round("gmp_pct", 4).alias("gmp_pct"), "anchor_quality")


@query("s1_documents", RICH + """ SELECT ipo_id, CAST(CASE WHEN subscription_fresh AND overall_x > 5 THEN 5 WHEN subscription_fresh AND overall_x >= 2 THEN 3 ELSE 0 END + CASE WHEN promoter_pledge_pct < 10 THEN 4 WHEN promoter_pledge_pct < 40 THEN 2 ELSE 0 END + CASE WHEN fresh_issue / 10 > 30 THEN 3 ELSE 0 END AS DOUBLE) AS final_score,
  CAST(CASE WHEN subscription_fresh AND overall_x IS NOT NULL THEN 0 ELSE 5 END + CASE WHEN promoter_pledge_pct IS NULL THEN 4 ELSE 0 END + CASE WHEN fresh_issue IS NULL THEN 3 ELSE 0 END AS DOUBLE) AS unknown_points FROM d""")
def s1_documents(spark, sf_dir):
    """Input documents in millions, evaluated under a policy."""
    from quillmark import api

    rows = issuers(spark, sf_dir)
    document = F.to_json(F.struct(
        F.struct(F.lit("INR_MILLIONS").alias("reporting_unit")).alias("financials"), F.struct("fresh_issue", "ofs").alias("issue"), F.struct("promoter_pledge_pct").alias("capital_structure"),
        F.struct(F.struct("overall_x", F.col("subscription_fresh").alias("fresh")).alias("subscription")).alias("market"),
    ))
    fresh = {"id": "G", "criteria": [{"id": "size", "max": 3, "metric": "gcp_legal_max", "rule": {"type": "bands", "bands": [[">", 7.5, 3]], "else": 0}}]}
    spec = api.load_config({"modules": [*[{k: m[k] for k in ("id", "criteria")} for m in OVERLAYS["modules"]], fresh]})
    return api.evaluate(rows.select("ipo_id", document.alias("document")), spec).select("ipo_id", "final_score", "unknown_points")
