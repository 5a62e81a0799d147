"""Workflow operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import metrics
from quillmark.operators import dataset, validate, workflow
from quillmark.plans.base import EVALUATIONS, OBSERVATIONS, evaluations, observations
from quillmark.plans.measures import RICH, issuers
from quillmark.plans.registry import query
from quillmark.sources import documents
from quillmark.sources.tables import table


@query("p20_gaps", """WITH m AS (SELECT l_orderkey AS evaluation_id, CASE l_returnflag WHEN 'R' THEN 'CRITERION' WHEN 'A' THEN 'PEER' ELSE 'OTHER' END AS category, 'c' || l_linenumber AS item, CASE WHEN l_tax > 0.02 THEN 'told' END AS detail, CASE WHEN l_discount > 0.02 THEN l_discount * 100 ELSE 0 END AS points FROM lineitem WHERE l_quantity < 10),
c AS (SELECT DISTINCT l_orderkey AS evaluation_id, 'c' || l_linenumber AS criterion, 'm' || (l_linenumber % 3) AS module FROM lineitem)
SELECT m.evaluation_id, m.category, m.item, CASE WHEN category = 'CRITERION' THEN c.module END AS module, CASE WHEN points > 0 THEN 'ESTABLISHED_BY_BASELINE' ELSE 'NOT_ESTABLISHED_BY_AVAILABLE_ARTIFACTS' END AS effect, round(CASE WHEN points > 0 THEN points END, 2) AS points_affected,
  CASE WHEN detail IS NULL THEN 'UNDETERMINED' ELSE 'STORED_EXPLANATION' END AS reason, CASE category WHEN 'CRITERION' THEN 'INSPECT_CRITERION' WHEN 'PEER' THEN 'INSPECT_PEER' ELSE 'INSPECT_ARTIFACTS' END AS next_step FROM m LEFT JOIN c ON m.evaluation_id = c.evaluation_id AND m.item = c.criterion""")
def p20_gaps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    item = F.concat(F.lit("c"), "l_linenumber")
    category = F.when(F.col("l_returnflag") == "R", "CRITERION").when(F.col("l_returnflag") == "A", "PEER").otherwise("OTHER")
    missing = li.where("l_quantity < 10").select(F.col("l_orderkey").alias("evaluation_id"), category.alias("category"), item.alias("item"), F.when(F.col("l_tax") > 0.02, "told").alias("detail"), F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 100).otherwise(0.0).alias("points_affected"))
    criteria = li.select(F.col("l_orderkey").alias("evaluation_id"), item.alias("criterion"), F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("module")).distinct()
    return workflow.gaps(missing, criteria).withColumn("points_affected", F.round("points_affected", 2)).drop("detail")


@query("r11_fields", """WITH c AS (SELECT l_suppkey % 50 AS ipo_id, CASE l_linenumber % 3 WHEN 0 THEN 'lot_size' WHEN 1 THEN 'price' ELSE 'ofs' END AS field, CAST(l_partkey % 3 AS VARCHAR) AS value, 's' || l_orderkey || '-' || l_linenumber AS source, l_orderkey * 10 + l_linenumber AS rank,
  l_quantity <> 7 AS same_issuer, l_quantity <> 9 AS same_window, l_discount <> 0.05 AS valid, l_tax > 0.07 AND l_quantity < 3 AS verified FROM lineitem),
u AS (SELECT * FROM c WHERE same_issuer AND same_window),
g AS (SELECT ipo_id, field, count(DISTINCT value) FILTER (valid AND verified) AS values, bool_or(valid AND verified) AS good, bool_or(valid) AS valid, arg_min(value, rank) FILTER (valid AND verified) AS value, arg_min(source, rank) FILTER (valid AND verified) AS source, min(value) FILTER (valid AND verified) AS low, list(value) FILTER (valid AND NOT verified) AS loose FROM u GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT range AS ipo_id FROM range(60)) i, (VALUES ('lot_size'), ('price'), ('ofs'), ('face_value')) f(field)),
s AS (SELECT k.ipo_id, k.field, g.* EXCLUDE (ipo_id, field), CASE WHEN g.field IS NULL THEN 'UNRESOLVED_AFTER_DISCOVERY' WHEN values > 1 THEN 'CONFLICT' WHEN good THEN 'VERIFIED' WHEN valid THEN 'CANDIDATE_AWAITING_VERIFICATION' ELSE 'MALFORMED_OR_AMBIGUOUS' END AS state FROM k LEFT JOIN g ON k.ipo_id = g.ipo_id AND k.field = g.field)
SELECT ipo_id, field, state, CASE WHEN state = 'VERIFIED' THEN value END AS value, CASE WHEN state = 'VERIFIED' THEN source END AS source, coalesce(good AND len(list_filter(loose, lambda v: v <> low)) > 0, false) AS unverified_disagrees FROM s""")
def r11_fields(spark, sf_dir):
    """Lines are candidates for a field of one of fifty issues; ten more issues have none."""
    field = F.when(F.col("l_linenumber") % 3 == 0, "lot_size").when(F.col("l_linenumber") % 3 == 1, "price").otherwise("ofs")
    candidates = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("ipo_id"), field.alias("field"), (F.col("l_partkey") % 3).cast("string").alias("value"), F.concat(F.lit("s"), "l_orderkey", F.lit("-"), "l_linenumber").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"),
        F.when(F.col("l_quantity") != 7, "own").otherwise("other").alias("issuer"), F.when(F.col("l_quantity") != 9, "a").otherwise("x").alias("open_date"), F.lit(None).cast("string").alias("close_date"), (F.col("l_discount") != 0.05).alias("valid"), ((F.col("l_tax") > 0.07) & (F.col("l_quantity") < 3)).alias("verified"),
    )
    issues = spark.range(60).select(F.col("id").alias("ipo_id"), F.lit("own").alias("issuer"), F.lit("a").alias("open_date"), F.lit("b").alias("close_date"))
    return workflow.resolved_fields(candidates, issues, ["lot_size", "price", "ofs", "face_value"])


def _enriched(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    even = F.col("s_nationkey") % 2 == 0
    base = s.select(F.col("s_suppkey").alias("ipo_id"), F.when(even, F.col("s_acctbal")).alias("revenue"), F.lit(None).cast("string").alias("moat_rating"), F.when(F.col("s_nationkey") == 3, "strong").alias("visibility_rating"))
    given = s.select(F.col("s_suppkey").alias("ipo_id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") + 1).alias("revenue"), F.when(F.col("s_nationkey") < 9, "follower").alias("moat_rating"), F.lit("moderate").alias("visibility_rating"))
    return base, given


@query("r10b_statutory", """SELECT s_suppkey AS ipo_id, 'TEMPLATE_OVERWRITE_DISALLOWED' AS code, 'WARNING' AS severity, unnest(list_filter([CASE WHEN s_acctbal > 0 THEN 'revenue' END, CASE WHEN s_nationkey < 9 THEN 'moat_rating' END, 'visibility_rating'], lambda x: x IS NOT NULL)) AS location FROM supplier""")
def r10b_statutory(spark, sf_dir):
    base, given = _enriched(spark, sf_dir)
    return workflow.owned(base, given, "ipo_id", [], "TEMPLATE_OVERWRITE_DISALLOWED")[1]


@query("r10c_analyst", """SELECT s_suppkey AS ipo_id, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal END AS revenue, CASE WHEN s_nationkey < 9 THEN 'follower' END AS moat_rating, CASE WHEN s_nationkey = 3 THEN 'strong' ELSE 'moderate' END AS visibility_rating, CASE WHEN s_acctbal > 0 THEN 'revenue' END AS refused FROM supplier""")
def r10c_analyst(spark, sf_dir):
    base, given = _enriched(spark, sf_dir)
    out, findings = workflow.owned(base, given, "ipo_id", ["moat_rating", "visibility_rating"], "ANALYST_OVERWRITE_DISALLOWED")
    refused = findings.select(F.col("ipo_id").alias("k"), F.col("location").alias("refused"))
    return out.join(refused, out["ipo_id"] == refused["k"], "left").drop("k")


@query("r10d_aliases", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value END, CASE WHEN user_id < 50 THEN CAST(user_id AS DOUBLE) END) AS qib_x, CASE WHEN event_type = 'click' THEN value END AS nii_x FROM events")
def r10d_aliases(spark, sf_dir):
    payload = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("qib"), F.when(F.col("user_id") < 50, F.col("user_id").cast("double")).alias("qualified_institutional"), F.when(F.col("event_type") == "click", F.col("value")).alias("non_institutional"))
    return workflow.by_alias(payload, {"qib_x": ["qib_times", "qib", "qualified_institutional"], "nii_x": ["nii", "non_institutional"]}, ["event_id"])


_SOLD = "CASE WHEN len(sellers) > 0 AND len(list_filter(sellers, lambda s: s.shares_sold IS NULL)) = 0 THEN list_sum(list_transform(sellers, lambda s: s.shares_sold)) END"
_OWN = "CASE WHEN sellers IS NOT NULL AND len(list_filter(sellers, lambda s: s.type IN ('promoter', 'promoter_group') AND s.shares_sold IS NULL)) = 0 THEN coalesce(list_sum(list_transform(list_filter(sellers, lambda s: s.type IN ('promoter', 'promoter_group')), lambda s: s.shares_sold)), 0) END"


def _four(column: str) -> str:
    return f"floor({column} * 1e4 + 0.5) / 1e4"


@query("r10e_derivations", RICH + f"""  , x1 AS (SELECT *, round(fresh_issue * 1e7 / CASE WHEN price_band_high > 0 THEN price_band_high END) AS d_fresh FROM d),
y1 AS (SELECT *, pre_issue_shares + coalesce(fresh_shares, d_fresh) AS d_post, coalesce(post_issue_shares, pre_issue_shares + coalesce(fresh_shares, d_fresh)) AS final, ({_SOLD}) * price_band_high / 1e7 AS d_ofs FROM x1),
z1 AS (SELECT *, round(pat * 1e7 / CASE WHEN final > 0 THEN final END, 2) AS d_eps, (promoter_pre_pct / 100 * pre_issue_shares - ({_OWN})) / CASE WHEN final > 0 THEN final END * 100 AS d_after FROM y1),
v1_ AS (SELECT *, abs(fresh_shares - d_fresh) / CASE WHEN d_fresh <> 0 THEN abs(d_fresh) END * 100 AS v1, abs(post_issue_shares - d_post) / CASE WHEN d_post <> 0 THEN abs(d_post) END * 100 AS v2, abs(ofs - d_ofs) / CASE WHEN d_ofs <> 0 THEN abs(d_ofs) END * 100 AS v3, abs(post_issue_eps - d_eps) / CASE WHEN d_eps <> 0 THEN abs(d_eps) END * 100 AS v4, abs(promoter_post_disclosed - d_after) AS v5 FROM z1)
SELECT ipo_id, {_four('coalesce(fresh_shares, d_fresh)')} AS fresh_shares, {_four('coalesce(post_issue_shares, d_post)')} AS post_issue_shares, {_four('coalesce(ofs, d_ofs)')} AS ofs, {_four('coalesce(post_issue_eps, d_eps)')} AS post_issue_eps, {_four('coalesce(promoter_post_disclosed, d_after)')} AS promoter_post_disclosed,
  array_to_string(list_filter([CASE WHEN v1 > 1 THEN 'fresh_shares' END, CASE WHEN v2 > 1 THEN 'post_issue_shares' END, CASE WHEN v3 > 1 THEN 'ofs' END, CASE WHEN v4 > 2 THEN 'post_issue_eps' END, CASE WHEN v5 > 1 THEN 'promoter_post_disclosed' END], lambda q: q IS NOT NULL), ',') AS unreconciled FROM v1_""")
def r10e_derivations(spark, sf_dir):
    from quillmark.plans.base import places

    made = workflow.derived_fields(issuers(spark, sf_dir))
    return made.select("ipo_id", *[places(F.col(f), 4).alias(f) for f in workflow.VARIANCE], F.array_join("unreconciled", ",").alias("unreconciled"))


@query("r10f_dispositions", RICH + """ SELECT ipo_id, f.field, CASE WHEN f.told THEN f.kind ELSE 'UNKNOWN' END AS disposition FROM d, LATERAL (VALUES ('qib_quota_pct', 'PRESERVED', qib_quota_pct IS NOT NULL), ('promoter_pledge_pct', 'PRESERVED', promoter_pledge_pct IS NOT NULL), ('anchor_quality', 'ASSEMBLED', anchor_quality IS NOT NULL), ('qib_x', 'ASSEMBLED', d.qib_x IS NOT NULL), ('fresh_shares', 'DERIVED', fresh_shares IS NOT NULL)) f(field, kind, told)""")
def r10f_dispositions(spark, sf_dir):
    return workflow.dispositions(issuers(spark, sf_dir), "ipo_id", ["qib_quota_pct", "promoter_pledge_pct"], ["anchor_quality", "qib_x"], ["fresh_shares"])


@query("r22_requests", f"""WITH {EVALUATIONS.strip()}, t AS (SELECT evaluation_id, ipo_id, mode, CASE WHEN row_number() OVER (PARTITION BY ipo_id, mode ORDER BY evaluated_at DESC, evaluation_id DESC) = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS state, CASE WHEN mode = 'ARCHIVED' THEN 'ARCHIVED' ELSE 'VISIBLE' END AS visibility, verdict = '1-URGENT' AS ratified, ipo_id % 7 = 0 AS withdrawn,
  CASE WHEN ipo_id % 11 = 0 THEN 'GOLDEN' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = evaluation_id AND l_linenumber > 5) THEN 'GOVERNED' ELSE 'STANDARD' END AS tier FROM evaluations),
q AS (SELECT event_id AS evaluation_id, ts AS at_, CASE event_type WHEN 'view' THEN 'archive' WHEN 'click' THEN 'unarchive' WHEN 'error' THEN 'activate' ELSE 'sleep' END AS action FROM events),
o AS (SELECT q.*, t.* EXCLUDE (evaluation_id), t.evaluation_id IS NULL AS absent, CASE WHEN t.evaluation_id IS NULL THEN 'NOT_FOUND'
  WHEN action = 'archive' THEN CASE WHEN tier = 'GOLDEN' THEN 'PROTECTED' WHEN state = 'ACTIVE' AND NOT withdrawn THEN 'ACTIVE_EVALUATION' WHEN visibility = 'ARCHIVED' THEN 'ALREADY_ARCHIVED' ELSE 'DONE' END
  WHEN action = 'unarchive' THEN CASE WHEN visibility <> 'ARCHIVED' THEN 'NOT_ARCHIVED' ELSE 'DONE' END
  WHEN action = 'activate' THEN CASE WHEN NOT ratified THEN 'UNRATIFIED_POLICY' WHEN visibility = 'ARCHIVED' THEN 'ARCHIVED' ELSE 'DONE' END ELSE 'UNKNOWN_ACTION' END AS outcome FROM q LEFT JOIN t ON t.evaluation_id = q.evaluation_id)
SELECT evaluation_id, action, outcome, CASE WHEN outcome = 'DONE' AND action = 'activate' THEN 'ACTIVE' WHEN outcome = 'DONE' AND action = 'unarchive' THEN 'SUPERSEDED' ELSE state END AS state, CASE WHEN outcome = 'DONE' AND action = 'archive' THEN 'ARCHIVED' WHEN outcome = 'DONE' AND action = 'unarchive' THEN 'VISIBLE' ELSE visibility END AS visibility FROM o""")
def r22_requests(spark, sf_dir):
    from quillmark.operators import versions

    e = evaluations(spark, sf_dir).withColumn("ratified", F.lit(False))
    states = versions.lifecycle(e, ["ipo_id", "mode"], [F.desc("evaluated_at"), F.desc("evaluation_id")]).withColumns({"ratified": F.col("verdict") == "1-URGENT", "visibility": F.when(F.col("mode") == "ARCHIVED", "ARCHIVED").otherwise("VISIBLE"), "withdrawn": F.col("ipo_id") % 7 == 0})
    observed = table(spark, sf_dir, "lineitem").where("l_linenumber > 5").select(F.col("l_orderkey").alias("evaluation_id"))
    tiered = workflow.protection(states, observed, F.col("ipo_id") % 11 == 0)
    kind = F.col("event_type")
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("evaluation_id"), F.when(kind == "view", "archive").when(kind == "click", "unarchive").when(kind == "error", "activate").otherwise("sleep").alias("action"), F.col("ts").alias("at"))
    return workflow.requested(tiered, requests).drop("at")


REGISTRY_ROWS = [("market.subscription.qib_x", "QIB", 0.0, 40.0, "EXCHANGE", True), ("financials.net_worth", "NW", None, None, "FILING", False), ("governance.pledge", "PLEDGE", 0.0, 30.0, "FILING", False)]
_ENTRY_TARGET = "CASE l_linenumber % 4 WHEN 0 THEN 'market.subscription.qib_x' WHEN 1 THEN 'financials.net_worth' WHEN 2 THEN 'governance.pledge' ELSE 'made.up' END"


@query("r23_admitted", f"""WITH e AS (SELECT l_orderkey AS evaluation_id, {_ENTRY_TARGET} AS target, CASE WHEN l_quantity <> 7 THEN l_quantity END AS value, CASE WHEN l_linestatus = 'O' THEN 'FILING' ELSE 'EXCHANGE' END AS source_type, CASE WHEN l_returnflag <> 'N' THEN 't' END AS observation_time, CASE WHEN l_tax > 0 THEN 'd' END AS artifact_digest, CASE WHEN l_discount > 0 THEN 'd' ELSE 'x' END AS stated_digest FROM lineitem),
r(target, gap_item, minimum, maximum, type, needs_time) AS (VALUES ('market.subscription.qib_x', 'QIB', 0.0, 40.0, 'EXCHANGE', true), ('financials.net_worth', 'NW', NULL, NULL, 'FILING', false), ('governance.pledge', 'PLEDGE', 0.0, 30.0, 'FILING', false)),
n AS (SELECT evaluation_id, target, count(*) AS n FROM e GROUP BY 1, 2)
SELECT e.*, array_to_string(list_filter([CASE WHEN n.n > 1 THEN 'DUPLICATE_TARGET' END, CASE WHEN r.target IS NULL THEN 'UNSUPPORTED_TARGET' END, CASE WHEN r.target IS NOT NULL AND NOT (e.evaluation_id % 2 = 0 AND gap_item = 'QIB' OR e.evaluation_id % 3 = 0 AND gap_item = 'NW') THEN 'TARGET_NOT_A_BASELINE_GAP' END, CASE WHEN e.evaluation_id % 5 = 0 AND e.target = 'financials.net_worth' THEN 'TARGET_ALREADY_ESTABLISHED_IN_LAYER1' END,
  CASE WHEN r.target IS NOT NULL AND value IS NULL THEN 'VALUE_TYPE' END, CASE WHEN value < minimum OR value > maximum THEN 'VALUE_RANGE' END, CASE WHEN needs_time AND observation_time IS NULL THEN 'OBSERVATION_TIME_REQUIRED' END, CASE WHEN r.target IS NOT NULL AND source_type <> type THEN 'SOURCE_TYPE_NOT_PERMITTED' END,
  CASE WHEN artifact_digest IS NULL THEN 'SOURCE_ARTIFACT_MISSING' END, CASE WHEN artifact_digest <> stated_digest THEN 'SOURCE_ARTIFACT_HASH_MISMATCH' END], lambda c: c IS NOT NULL), ',') AS errors
FROM e LEFT JOIN r ON e.target = r.target JOIN n ON e.evaluation_id = n.evaluation_id AND e.target = n.target""")
def r23_admitted(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evaluation_id"))
    entries = li.select(F.col("l_orderkey").alias("evaluation_id"), F.expr(_ENTRY_TARGET).alias("target"), F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("value"), F.when(F.col("l_linestatus") == "O", "FILING").otherwise("EXCHANGE").alias("source_type"), F.when(F.col("l_returnflag") != "N", "t").alias("observation_time"), F.when(F.col("l_tax") > 0, "d").alias("artifact_digest"), F.when(F.col("l_discount") > 0, "d").otherwise("x").alias("stated_digest"))
    registry = spark.createDataFrame(REGISTRY_ROWS, "target string, gap_item string, minimum double, maximum double, source_type string, needs_time boolean")
    gaps = o.where("evaluation_id % 2 = 0").withColumn("item", F.lit("QIB")).unionByName(o.where("evaluation_id % 3 = 0").withColumn("item", F.lit("NW")))
    established = o.where("evaluation_id % 5 = 0").withColumn("target", F.lit("financials.net_worth"))
    return workflow.admitted(entries, registry, gaps, established).withColumn("errors", F.array_join("errors", ","))


SECONDARY = {
    "modules": [
        {"id": "B", "criteria": [{"id": "demand", "max": 5, "metric": "overall_x", "rule": {"type": "bands", "bands": [[">", 5, 5], [">=", 2, 3]], "else": 0}}]},
        {"id": "D", "criteria": [{"id": "pledge", "max": 4, "metric": "promoter_pledge_pct", "rule": {"type": "bands", "bands": [["<", 10, 4], ["<", 40, 2]], "else": 0}}]},
    ]
}


@query("r24_secondary", RICH + """, e AS (SELECT o_custkey AS ipo_id, max(o_orderdate) AS evaluated_at, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 50000 END) AS overall, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 10000 END) AS pledge FROM orders GROUP BY 1),
x AS (SELECT d.ipo_id, evaluated_at, CASE WHEN subscription_fresh THEN overall_x END AS o1, CASE WHEN subscription_fresh THEN coalesce(overall, overall_x) END AS o2, promoter_pledge_pct AS p1, coalesce(pledge, promoter_pledge_pct) AS p2 FROM d JOIN e ON d.ipo_id = e.ipo_id),
s AS (SELECT *, CASE WHEN o1 > 5 THEN 5 WHEN o1 >= 2 THEN 3 ELSE 0 END AS b1, CASE WHEN o2 > 5 THEN 5 WHEN o2 >= 2 THEN 3 ELSE 0 END AS b2, CASE WHEN p1 < 10 THEN 4 WHEN p1 < 40 THEN 2 ELSE 0 END AS d1, CASE WHEN p2 < 10 THEN 4 WHEN p2 < 40 THEN 2 ELSE 0 END AS d2 FROM x)
SELECT ipo_id, 'B' AS module, CAST(b1 AS DOUBLE) AS before, CAST(b2 AS DOUBLE) AS after, CAST(b2 - b1 AS DOUBLE) AS delta, CAST(evaluated_at AS DATE) AS evaluated_at FROM s UNION ALL SELECT ipo_id, 'D', d1, d2, d2 - d1, CAST(evaluated_at AS DATE) FROM s""")
def r24_secondary(spark, sf_dir):
    """Orders are admitted entries: finished ones tell the demand, open ones the pledge."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ipo_id"), F.when(F.col("o_orderstatus") == "F", "market.overall_x").when(F.col("o_orderstatus") == "O", "governance.pledge").otherwise("none").alias("target"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 50000).otherwise(F.col("o_totalprice") / 10000).alias("value"), F.col("o_orderdate").alias("observation_time"))
    made = workflow.secondary(issuers(spark, sf_dir), entries, "ipo_id", SECONDARY, {"market.overall_x": "overall_x", "governance.pledge": "promoter_pledge_pct"}, ["overall_x", "promoter_pledge_pct"])
    return made.withColumn("evaluated_at", F.to_date("evaluated_at"))


@query("r25_scenario", """WITH RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, (l_quantity - 25) / 2 AS d FROM lineitem),
f AS (SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS i, CAST(10 AS DOUBLE) AS a FROM orders UNION ALL SELECT f.k, l.i, greatest(0, least(20, f.a + l.d)) FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1), g AS (SELECT k, arg_max(a, i) AS a FROM f GROUP BY 1),
t AS (SELECT o_orderkey AS evaluation_id, o_custkey, o_orderstatus, greatest(0, least(100, o_custkey % 100 + coalesce(a, 10) - 10)) AS score FROM orders LEFT JOIN g ON k = o_orderkey)
SELECT evaluation_id, CAST(score AS DOUBLE) AS score, CASE WHEN o_orderstatus = 'P' THEN 'AVOID' WHEN score >= 75 THEN 'APPLY' WHEN score >= 60 THEN 'APPLY_SELECTIVELY' WHEN score >= 45 THEN 'NEUTRAL' ELSE 'AVOID' END AS verdict FROM t""")
def r25_scenario(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("k"), "left")
    deltas = F.transform(F.coalesce("lines", F.array().cast(li.schema["lines"].dataType)), lambda x: (x["l_quantity"] - 25) / 2)
    score, verdict = workflow.scenario((F.col("o_custkey") % 100).cast("double"), [(F.lit(10.0), deltas, 20)], F.col("o_orderstatus") == "P")
    return o.select(F.col("o_orderkey").alias("evaluation_id"), score.alias("score"), verdict.alias("verdict"))


@query("r16_verified", """SELECT event_id, event_type <> 'error' AS hash_matches FROM events""")
def r16_verified(spark, sf_dir):
    """Stored digests against recomputed ones, of which those of errors were written over."""
    from quillmark.functions import hashing

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", hashing.json_digest(F.to_json(F.struct("event_id", "event_type", "user_id")), wrapped=False).alias("right"))
    stored = rows.withColumn("digest", F.when(F.col("event_type") != "error", F.col("right")).otherwise("0"))
    return workflow.verified(stored, ["user_id", "event_id", "event_type"], "digest").select("event_id", "hash_matches")


@query("r27_records", """SELECT o_orderkey, sha256('{"identity":{"customer":' || o_custkey || ',"key":' || o_orderkey || '},"result":{"status":"' || o_orderstatus || '"}}') AS integrity FROM orders""")
def r27_records(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    return workflow.projected(rows, {"result": ["status"], "identity": ["key", "customer"]}).select("o_orderkey", "integrity")


@query("s6_full_records", """WITH l AS (SELECT l_orderkey, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1) SELECT o_orderkey AS evaluation_id, lines AS evidence_lines, quantity AS evidence_quantity, event_type AS market_kind FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN events ON event_id = o_orderkey""")
def s6_full_records(spark, sf_dir):
    e = evaluations(spark, sf_dir).select("evaluation_id")
    evidence = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("evaluation_id")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    market = table(spark, sf_dir, "events").select(F.col("event_id").alias("evaluation_id"), F.col("event_type").alias("kind"))
    return workflow.full(e, {"evidence": evidence, "market": market}).select("evaluation_id", F.col("evidence.lines").alias("evidence_lines"), F.col("evidence.quantity").alias("evidence_quantity"), F.col("market.kind").alias("market_kind"))


@query("j5_assembled", f"""WITH {EVALUATIONS.strip()}, {OBSERVATIONS.strip()}, f AS (SELECT * FROM observations o WHERE NOT EXISTS (SELECT 1 FROM observations s WHERE s.supersedes = o.observation_id)),
e AS (SELECT evaluation_id, horizon, arg_max(return_pct, version) AS r, arg_max(CASE WHEN symbol % 7 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END, version) AS s FROM f GROUP BY 1, 2),
w AS (SELECT evaluation_id, max(r) FILTER (horizon = '1W') AS return_1w, coalesce(max(s) FILTER (horizon = '1W'), 'INCOMPLETE') AS status_1w, max(r) FILTER (horizon = '1M') AS return_1m, coalesce(max(s) FILTER (horizon = '1M'), 'INCOMPLETE') AS status_1m, max(r) FILTER (horizon = '6M') AS return_6m, coalesce(max(s) FILTER (horizon = '6M'), 'INCOMPLETE') AS status_6m FROM e GROUP BY 1),
j AS (SELECT v.evaluation_id, return_1w, coalesce(status_1w, 'INCOMPLETE') AS status_1w, return_1m, coalesce(status_1m, 'INCOMPLETE') AS status_1m, return_6m, coalesce(status_6m, 'INCOMPLETE') AS status_6m, c_acctbal AS balance, c_custkey IS NOT NULL AS has_input FROM evaluations v LEFT JOIN w USING (evaluation_id) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = ipo_id WHERE mode = 'FINAL')
SELECT *, CASE WHEN NOT has_input THEN 'INVALID' WHEN 'UNVERIFIED' IN (status_1w, status_1m, status_6m) THEN 'UNVERIFIED' WHEN return_1w IS NOT NULL AND return_1m IS NOT NULL AND return_6m IS NOT NULL THEN 'READY' WHEN coalesce(return_1w, return_1m, return_6m) IS NOT NULL THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS row_status FROM j""")
def j5_assembled(spark, sf_dir):
    """Final evaluations, the observations in force, and input snapshots, which issuers in debt lack."""
    from quillmark.operators import versions

    force = versions.effective(versions.in_force(observations(spark, sf_dir), "observation_id", "supersedes"), ["evaluation_id", "horizon"], "version").withColumn("observation_status", F.when(F.col("symbol") % 7 == 0, "UNVERIFIED").otherwise("VERIFIED"))
    e = evaluations(spark, sf_dir).select("evaluation_id", "ipo_id", "mode")
    inputs = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("__c"), F.col("c_acctbal").alias("balance")).join(e.select("evaluation_id", "ipo_id"), F.col("__c") == F.col("ipo_id")).select("evaluation_id", "balance")
    return dataset.assembled(e, force, inputs, "evaluation_id").drop("ipo_id", "mode")


@query("o5_activity", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def o5_activity(spark, sf_dir):
    """The latest fifty activities."""
    from quillmark.operators import versions

    return versions.page(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 1, 50).select("event_id", "event_type")


@query("s9_subscriptions", "SELECT c_custkey, c_custkey / 100.0 AS qib_x, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS nii_x, CAST(2.5 AS DOUBLE) AS overall_x FROM (SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer)")
def s9_subscriptions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    payload = F.to_json(F.struct((F.col("c_custkey") / 100).cast("string").alias("qib"), F.when(F.col("c_custkey") % 3 == 0, F.abs("c_acctbal")).alias("nii"), F.lit("2.5").alias("total")))
    return documents.subscriptions(c.select("c_custkey", payload.alias("payload"))).select("c_custkey", "qib_x", "nii_x", "overall_x")


@query("s12_peers", "SELECT s_suppkey AS ipo_id, n_name AS name, round(abs(s_acctbal) + n_nationkey, 2) AS pe FROM supplier JOIN nation ON n_regionkey = s_nationkey % 5")
def s12_peers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    met = table(spark, sf_dir, "supplier").join(n, F.col("n_regionkey") == F.col("s_nationkey") % 5)
    payload = met.groupBy(F.col("s_suppkey").alias("ipo_id")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("name"), F.round(F.abs("s_acctbal") + F.col("n_nationkey"), 2).alias("pe"))).alias("peers"))).alias("payload"))
    return documents.peers(payload, "ipo_id").select("ipo_id", "name", "pe")


@query("s16_exchange_rows", "SELECT s_suppkey, s_name AS company, 'SME' AS series, s_nationkey % 2 = 0 AS is_open, CAST(s_nationkey AS DOUBLE) AS price_low, CAST(s_nationkey + 5 AS DOUBLE) AS price_high FROM supplier")
def s16_exchange_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    row = F.struct(F.col("s_name").alias("companyName"), F.lit("sme").alias("series"), F.when(F.col("s_nationkey") % 2 == 0, "Active").otherwise("Closed").alias("status"), F.concat(F.lit("Rs.", ), "s_nationkey", F.lit(" to Rs."), F.col("s_nationkey") + 5).alias("issuePrice"))
    return documents.exchange_rows(s.select("s_suppkey", F.to_json(F.struct(F.array(row).alias("data"))).alias("payload")), ["s_suppkey"])


@query("r12_issue_rules", RICH + """ SELECT ipo_id, unnest(list_filter([CASE WHEN years < 3 THEN 'TOO_FEW_PERIODS' END, CASE WHEN len(list_filter(coalesce(sellers, []), lambda s: s.shares_sold > s.pre_issue_shares)) > 0 THEN 'OVERSOLD' END, CASE WHEN abs(pre_issue_shares + fresh_shares - post_issue_shares) > abs(post_issue_shares) * 0.005 THEN 'SHARE_COUNT' END,
  CASE WHEN coalesce(list_sum(list_transform(list_filter(proceeds, lambda x: x.category = 'gcp'), lambda x: coalesce(x.amount, 0))), 0) / nullif(fresh_issue, 0) * 100 > 25 THEN 'GCP_LIMIT' END], lambda c: c IS NOT NULL)) AS code FROM d""")
def r12_issue_rules(spark, sf_dir):
    rules_ = {c: r for c, r in validate.issue_rules().items() if c in ("TOO_FEW_PERIODS", "OVERSOLD", "SHARE_COUNT", "GCP_LIMIT")}
    return validate.findings(metrics.complete(issuers(spark, sf_dir)).withColumn("fresh_issue", F.when(F.col("fresh_issue") != 0, F.col("fresh_issue"))), "ipo_id", rules_).select("ipo_id", "code")


@query("k2_manifest", f"WITH {OBSERVATIONS.strip()} SELECT evaluation_id, count(*) AS rows, sha256(array_to_string(list_sort(list(DISTINCT horizon || ':' || version)), ',')) AS digest FROM observations GROUP BY 1")
def k2_manifest(spark, sf_dir):
    from quillmark.sources.sinks import manifest

    return manifest(observations(spark, sf_dir), "evaluation_id", "horizon", "version")


@query("k3_flat_rows", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags, count(*) AS n FROM lineitem GROUP BY 1")
def k3_flat_rows(spark, sf_dir):
    from quillmark.sources.sinks import flat

    return flat(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"), F.count(F.lit(1)).alias("n")))


@query("r21_policy_diff", "SELECT * FROM (VALUES ('B.demand.max', '5', '6'), ('B.demand.new', NULL, '1'), ('verdict', '\"AVOID\"', NULL)) d(path, before, after)")
def r21_policy_diff(spark, sf_dir):
    """Where two policies differ, by dotted paths."""
    import json

    from quillmark.operators.calibrate import changed_paths

    old, new = {"B": {"demand": {"max": 5, "metric": "x"}}, "verdict": "AVOID"}, {"B": {"demand": {"max": 6, "metric": "x", "new": 1}}}
    told = lambda v: None if v is None else json.dumps(v)
    return spark.createDataFrame([(p, told(a), told(b)) for p, a, b in changed_paths(old, new)], "path string, before string, after string")


@query("u4_domains", "SELECT * FROM (VALUES ('auditor_bucket', 'eom_only', 'missing'), ('auditor_bucket', 'odd', 'extra'), ('lockin_bucket', 'weak', 'missing')) g(metric, category, gap)")
def u4_domains(spark, sf_dir):
    """Categories that a policy's maps lack, or have too many of."""
    from quillmark.functions.rules import domain_gaps

    mapped = {"auditor_bucket": ["clean_reputed", "unstable_or_repeated_eom", "odd"], "lockin_bucket": ["intact"]}
    rows = [(m, c, kind) for m, own in mapped.items() for kind, found in zip(("missing", "extra"), domain_gaps(list(metrics.DOMAINS[m]), own), strict=True) for c in found]
    return spark.createDataFrame(rows, "metric string, category string, gap string")


@query("t4_many_prefixes", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey >= 1000 THEN 'p' || (l_partkey // 10) WHEN l_partkey >= 10 THEN 'p' || (l_partkey // 10) END AS category FROM lineitem")
def t4_many_prefixes(spark, sf_dir):
    """Keys by the longest of a table of prefixes that is too large for a literal: all but their last digit."""
    from quillmark.functions.text import longest_prefix

    part = table(spark, sf_dir, "part").where("p_partkey >= 10").select(F.expr("p_partkey div 10").cast("string").alias("prefix")).distinct()
    return longest_prefix(table(spark, sf_dir, "lineitem").withColumn("key", F.concat(F.lpad(F.length(F.col("l_partkey").cast("string")).cast("string"), 2, "0"), F.col("l_partkey").cast("string"))), "key", part.select(F.concat(F.lpad((F.length("prefix") + 1).cast("string"), 2, "0"), "prefix").alias("prefix"), F.concat(F.lit("p"), "prefix").alias("category")), most=50).select("l_orderkey", "l_linenumber", "l_partkey", "category")
