"""Every derived metric over issuers with all kinds of gaps, each beside its rule in SQL.

Customers are issuers. Their yearly orders give the periods, and whole-number
arithmetic on keys, years and counts gives the other figures, which are missing
here and there. The expressions of the inputs are shared by both engines; the
rules are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import metrics
from quillmark.plans.base import places
from quillmark.plans.registry import query
from quillmark.sources.tables import table

#: Figures of a year: r its revenue, n its orders, u a number from 0 to 999.
PERIOD = {
    "revenue": "CASE WHEN u % 29 <> 5 THEN r END",
    "ebitda": "CASE WHEN u % 31 <> 3 THEN r * (1e-1 + (u % 7) * 3e-2) END",
    "ebit": "CASE WHEN u % 13 <> 6 THEN r * 8e-2 END",
    "pat": "CASE WHEN u % 37 <> 9 THEN r * ((u % 6) - 1) * 2e-2 END",
    "net_worth": "CASE WHEN u % 41 <> 11 THEN r * ((u % 8) - 5e-1) * 2e-1 END",
    "total_debt": "CASE WHEN u % 17 <> 8 THEN r * (u % 5) * 1.5e-1 END",
    "interest_expense": "CASE WHEN u % 11 <> 10 THEN r * (u % 3) * 1e-2 END",
    "cfo": "CASE WHEN u % 43 <> 4 THEN r * ((u % 4) - 5e-1) * 3e-2 END",
    "cash_and_equivalents": "CASE WHEN u % 23 <> 2 THEN r * 5e-2 * (u % 4) END",
    "order_book": "CASE WHEN u % 3 <> 0 THEN r * (u % 5) END",
    "pre_sales": "CASE WHEN u % 5 <> 0 THEN r * 5e-1 END",
    "collections": "CASE WHEN u % 7 <> 0 THEN r * 1e-1 * (u % 9) END",
    "receivable_days": "CASE WHEN u % 19 <> 1 THEN (u % 61) * 1e0 END",
    "disclosed_roce_pct": "CASE WHEN u % 10 = 9 THEN 18e0 + u % 4 END",
    "contribution_margin_pct": "CASE WHEN u % 47 <> 7 THEN (u % 23) * 1e0 - 4 END",
    "operating_loss_pct_revenue": "CASE WHEN u % 53 <> 7 THEN (u % 13) * 1e0 END",
    "nim_pct": "CASE WHEN u % 59 <> 7 THEN 2e0 + (u % 4) * 5e-1 END",
    "cost_to_income_pct": "CASE WHEN u % 61 <> 7 THEN 40e0 + u % 5 END",
    "gnpa_pct": "CASE WHEN u % 67 <> 7 THEN (u % 9) * 8e-1 END",
    "provision_coverage_pct": "CASE WHEN u % 6 <> 5 THEN 60e0 + (u % 5) * 5 END",
    "crar_pct": "CASE WHEN u % 2 = 0 THEN 12e0 + u % 7 END",
    "tier1_pct": "CASE WHEN u % 9 <> 1 THEN 11e0 + u % 3 END",
    "roe_pct": "CASE WHEN u % 5 = 0 THEN 15e0 + u % 12 END",
}
#: Facts of an issuer: k its key, h a number from 0 to 1008.
FACTS = {
    "fresh_issue": "CASE WHEN h % 5 = 0 THEN 0e0 WHEN h % 11 <> 3 THEN 100e0 + h % 400 END",
    "ofs": "CASE WHEN h % 4 = 0 THEN 0e0 WHEN h % 13 <> 5 THEN 50e0 + h % 200 END",
    "fresh_shares": "CASE WHEN h % 29 <> 2 THEN (h % 17) * 1e5 END",
    "pre_issue_shares": "CASE WHEN h % 31 <> 2 THEN 1e6 * (1 + h % 9) END",
    "post_issue_shares": "CASE WHEN h % 6 = 1 THEN 1e6 * (2 + h % 9) END",
    "post_issue_eps": "CASE WHEN h % 7 = 1 THEN 5e0 - h % 9 END",
    "price_band_high": "CASE WHEN h % 37 <> 2 THEN 50e0 + h % 500 END",
    "market_cap": "CASE WHEN h % 8 = 1 THEN 40e0 + h % 90 END",
    "promoter_pre_pct": "CASE WHEN h % 12 <> 1 THEN 40e0 + h % 50 END",
    "promoter_post_disclosed": "CASE WHEN h % 7 = 2 THEN (h % 3) * 20e0 END",
    "promoter_pledge_pct": "CASE WHEN h % 9 <> 4 THEN (h % 80) * 1e0 END",
    "rpt_pct_revenue": "CASE WHEN h % 9 <> 5 THEN (h % 40) * 1e0 END",
    "rpt_pct_of_revenue_growth": "CASE WHEN h % 9 <> 6 THEN (h % 30) * 1e0 END",
    "industry_cagr": "CASE WHEN h % 9 <> 7 THEN (h % 25) * 1e0 END",
    "top5_customer_pct": "CASE WHEN h % 10 <> 7 THEN (h % 90) * 1e0 END",
    "top5_supplier_pct": "CASE WHEN h % 10 <> 6 THEN (h % 70) * 1e0 END",
    "contingent_liabilities": "CASE WHEN h % 10 <> 5 THEN (h % 900) * 1e2 END",
    "qib_quota_pct": "CASE WHEN h % 10 <> 4 THEN (h % 75) * 1e0 END",
    "qib_x": "CASE WHEN h % 10 <> 3 THEN (h % 60) * 1e-1 END",
    "nii_x": "CASE WHEN h % 10 <> 2 THEN (h % 50) * 1e-1 END",
    "retail_x": "CASE WHEN h % 10 <> 1 THEN (h % 40) * 1e-1 END",
    "overall_x": "CASE WHEN h % 10 <> 0 THEN (h % 70) * 1e-1 END",
    "kmp_exits_2y": "CASE WHEN h % 8 <> 3 THEN (h % 4) * 1e0 END",
    "crar_minimum_pct": "CASE WHEN h % 3 = 1 THEN 12e0 END",
    "operating_cash_flow_3yr": "CASE WHEN h % 14 <> 3 THEN (h % 90) * 1e0 END",
    "net_income_3yr": "CASE WHEN h % 15 <> 3 THEN (h % 101) * 1e0 - 9 END",
    "trade_receivables_days": "CASE WHEN h % 16 <> 3 THEN (h % 150) * 1e0 END",
    "net_working_capital_pct_revenue": "CASE WHEN h % 17 <> 3 THEN (h % 71) * 1e0 END",
    "promoter_pledged_shares_pct": "CASE WHEN h % 18 <> 3 THEN (h % 76) * 1e0 END",
    "pre_issue_promoter_holding_pct": "CASE WHEN h % 19 <> 3 THEN (h % 60) * 1e0 END",
    "top_customer_revenue_pct": "CASE WHEN h % 20 <> 3 THEN (h % 77) * 1e0 END",
    "contingent_liabilities_pct_net_worth": "CASE WHEN h % 21 <> 3 THEN (h % 51) * 1e0 END",
    "auditor_opinion": "CASE h % 7 WHEN 0 THEN 'qualified' WHEN 1 THEN 'adverse' WHEN 2 THEN 'emphasis_of_matter' WHEN 3 THEN 'carried' WHEN 4 THEN NULL ELSE 'unqualified' END",
    "litigation_bucket": "CASE h % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'minor_civil' WHEN 2 THEN 'criminal_or_regulatory' END",
    "eom_materiality": "CASE h % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END",
    "industry_scope": "CASE WHEN h % 3 <> 0 THEN 'india' END",
    "industry_forecast_period": "CASE WHEN h % 5 <> 0 THEN '2024-2029' END",
    "industry_source": "CASE WHEN h % 7 <> 0 THEN 'report' END",
    "moat_rating": "CASE WHEN h % 3 <> 1 THEN 'follower' END",
    "visibility_rating": "CASE WHEN h % 3 <> 2 THEN 'moderate' END",
    "anchor_quality": "CASE WHEN h % 4 <> 1 THEN 'reputed' END",
    "gmp_trend": "CASE WHEN h % 4 <> 2 THEN 'flat' END",
    "market_trend": "CASE WHEN h % 4 <> 3 THEN 'neutral' END",
    "open_date": "CASE WHEN h % 24 <> 3 THEN '1998-06-30' END",
    "placement_coverage": "CASE h % 5 WHEN 0 THEN 'VERIFIED_NIL' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'DISCLOSED' END",
    **{
        name: f"CASE WHEN h % {m} <> 2 THEN h % {m} < {m // 2} END"
        for name, m in (("promoter_lockin_in_place", 5), ("large_holders_unlocked_early", 6), ("auditor_changed_3y", 9), ("auditor_reputed", 5), ("repeated_eom", 8), ("board_independent_majority", 7), ("going_concern_uncertainty", 11), ("sebi_ed_action_active", 12), ("auditor_or_cfo_exit_2y", 13), ("regulatory_dependence", 14), ("contingent_liab_unquantified", 15), ("adjusted_metrics_unreconciled", 16), ("heavy_discounted_allotments_18m", 17), ("anchor_fresh", 18), ("subscription_fresh", 19), ("gmp_fresh", 20), ("regime_fresh", 21), ("professionally_managed", 22), ("loss_making_segments_present", 23), ("material_regulatory_disputes_present", 24))
    },
}
#: Lists of an issuer: how many entries, and the fields of the i-th.
LISTS = {
    "sellers": ("h % 4", {"type": "CASE (h + i) % 5 WHEN 0 THEN 'promoter' WHEN 1 THEN 'promoter_group' WHEN 2 THEN 'pe_vc' ELSE 'other' END", "pre_issue_shares": "CASE WHEN (h + i) % 13 <> 1 THEN 1e5 * ((h + i) % 6) END", "shares_sold": "CASE WHEN (h + i) % 11 <> 1 THEN 4e4 * ((h + 2 * i) % 5) END"}),
    "proceeds": ("h % 5", {"category": "CASE (h + 2 * i) % 6 WHEN 0 THEN 'gcp' WHEN 1 THEN 'growth_capex' WHEN 2 THEN 'rnd' WHEN 3 THEN 'debt_repayment' WHEN 4 THEN 'acquisition_unidentified' ELSE 'working_capital' END", "amount": "CASE WHEN (h + i) % 17 <> 1 THEN (h % 4) * 3e1 + 2e1 * i END"}),
    "placements": ("h % 3", {"date": "CASE WHEN (h + i) % 4 = 0 THEN '1996-01-01' ELSE '1998-02-01' END", "price": "CASE WHEN (h + i) % 14 <> 1 THEN 40e0 + (h * 7 + 90 * i) % 520 END"}),
    "peers": ("h % 5", {"pe": "CASE WHEN (h + i) % 6 <> 1 THEN 5e0 + (h + 3 * i) % 20 END", "ev_ebitda": "CASE WHEN (h + i) % 3 <> 1 THEN 4e0 + (h + 5 * i) % 9 END", "pb": "CASE WHEN (h + i) % 7 <> 1 THEN 1e0 + (h + i) % 4 END", "ps": "CASE WHEN (h + i) % 8 <> 1 THEN 1e0 + (h + 2 * i) % 3 END", "roe_pct": "CASE WHEN (h + i) % 9 <> 1 THEN 4e0 + (h + 7 * i) % 25 END", "roa_pct": "CASE WHEN (h + i) % 9 <> 2 THEN 1e0 + i END"}),
    "sector_ipos": ("h % 4", {"": "5e0 + (h + 6 * i) % 30"}),
    "listing_gains": ("h % 6", {"": "(h * 3 + 17 * i) % 60 * 1e0"}),
}


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ipo_id and all that the metrics read) of every customer."""
    o = table(spark, sf_dir, "orders")
    y = o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("fy")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("r"), F.count(F.lit(1)).alias("n"))
    y = y.withColumn("u", F.expr("(k * 31 + fy * 17 + n * 7) % 1000"))
    period = F.struct(F.col("fy").cast("string").alias("fy"), F.lit(False).alias("is_stub"), *[F.expr(PERIOD.get(f, "NULL")).cast("double").alias(f) for f in metrics.PERIOD_FIELDS])
    ordered = F.array_sort(F.collect_list(period))
    # The year of orders without a date is the last, as in SQL.
    years = y.groupBy("k").agg(F.concat(F.filter(ordered, lambda p: p["fy"].isNotNull()), F.filter(ordered, lambda p: p["fy"].isNull())).alias("periods"))
    facts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("h", F.expr("(k * 7919 + 13) % 1009"))

    def listed(count: str, fields: dict[str, str]) -> str:
        made = fields[""] if "" in fields else "named_struct(" + ", ".join(f"'{name}', {e}" for name, e in fields.items()) + ")"
        return f"CASE WHEN h % 25 <> 1 THEN transform(slice(array(0, 1, 2, 3, 4, 5), 1, cast({count} AS int)), i -> {made}) END"

    made = facts.join(years, "k", "left").withColumnRenamed("k", "ipo_id")
    return made.select("ipo_id", "periods", *[F.expr(e).alias(c) for c, e in FACTS.items()], *[F.expr(listed(*of)).cast(metrics.ARRAYS[c]).alias(c) for c, of in LISTS.items()])


def _listed_sql(count: str, fields: dict[str, str]) -> str:
    made = fields[""] if "" in fields else "{" + ", ".join(f"'{name}': {e}" for name, e in fields.items()) + "}"
    return f"CASE WHEN h % 25 <> 1 THEN list_transform(range({count}), lambda i: {made}) END"


def _known(*lists: str) -> str:
    return " AND ".join(f"len(list_filter({x}, lambda v: v IS NULL)) = 0" for x in lists)


def _deltas(values: str, test: str) -> str:
    return f"len(list_filter(range(2, len({values}) + 1), lambda j: {values}[j] - {values}[j - 1] {test}))"


def _trend(e: str, p: str) -> str:
    moves = f"len({e}) - 1"
    return f"""CASE WHEN len({e}) >= 2 AND {_known(e, p)} THEN CASE WHEN pat <= 0 OR ({_deltas(e, '< 0')} = {moves} AND {_deltas(p, '< 0')} = {moves}) THEN 'declining_or_loss'
      WHEN {_deltas(e, '> 0')} = {moves} AND {_deltas(p, '> 0')} = {moves} THEN 'expanding'
      WHEN {_deltas(e, '> 0')} > 0 AND {_deltas(e, '< 0')} > 0 AND list_max({e}) - list_min({e}) > 3 THEN 'volatile' ELSE 'stable' END END"""


def _of(kinds: str, field: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(sellers, lambda s: s.type IN ({kinds})), lambda s: coalesce(s.{field}, 0))), 0)"


def _category(kind: str) -> str:
    """Total of a category: nil if it isn't listed, null if an amount is untold."""
    own = f"list_filter(proceeds, lambda x: x.category = '{kind}')"
    return f"CASE WHEN len(list_filter({own}, lambda x: x.amount IS NULL)) = 0 THEN coalesce(list_sum(list_transform({own}, lambda x: x.amount)), 0) END"


_PROMOTERS = "'promoter', 'promoter_group'"
_FIELDS = list(PERIOD)
RICH = f"""
WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS fy, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS r, count(*) AS n FROM orders GROUP BY 1, 2),
z AS (SELECT *, (k * 31 + fy * 17 + n * 7) % 1000 AS u FROM y),
f AS (SELECT k, fy, {', '.join(f"{PERIOD[c]} AS {c}" for c in _FIELDS)} FROM z),
g AS (SELECT k, count(*) AS years, {', '.join(f"list({c} ORDER BY fy) AS {c}_l" for c in _FIELDS)}, list(CASE WHEN revenue <> 0 THEN ebitda / revenue * 100 END ORDER BY fy) AS em, list(CASE WHEN revenue <> 0 THEN pat / revenue * 100 END ORDER BY fy) AS pm FROM f GROUP BY 1),
w AS (SELECT c_custkey AS k, (c_custkey * 7919 + 13) % 1009 AS h FROM customer),
i AS (SELECT k AS ipo_id, coalesce(years, 0) AS years, em, pm, {', '.join(f"{c}_l, {c}_l[-1] AS {c}, {c}_l[-2] AS {c}_1, {c}_l[-3] AS {c}_2, {c}_l[-4] AS {c}_3" for c in _FIELDS)}, {', '.join(f"{e} AS {c}" for c, e in FACTS.items())}, {', '.join(f"{_listed_sql(*of)} AS {c}" for c, of in LISTS.items())} FROM w LEFT JOIN g USING (k)),
a AS (SELECT *, coalesce(post_issue_shares, pre_issue_shares + fresh_shares) AS shares, coalesce(list_sum(list_transform(list_slice(ebitda_l, -5, -1), lambda v: v)), 0) AS e5, list_median_pe.* FROM i, LATERAL (SELECT list_aggregate(list_transform(peers, lambda q: q.pe), 'median') AS mpe, list_aggregate(list_transform(peers, lambda q: q.ev_ebitda), 'median') AS mev, list_aggregate(list_transform(peers, lambda q: q.pb), 'median') AS mpb, list_aggregate(list_transform(peers, lambda q: q.ps), 'median') AS mps, list_aggregate(list_transform(peers, lambda q: q.roe_pct), 'median') AS mroe, list_aggregate(list_transform(peers, lambda q: q.roe_pct), 'min') AS lroe, list_aggregate(list_transform(peers, lambda q: q.roe_pct), 'max') AS hroe, len(list_filter(peers, lambda q: q.roe_pct IS NOT NULL)) AS nroe) list_median_pe),
b AS (SELECT *, coalesce(market_cap, price_band_high * shares / 1e7) AS mcap, coalesce(post_issue_eps, CASE WHEN shares > 0 THEN pat * 1e7 / shares END) AS eps, sellers_known.* FROM a, LATERAL (SELECT coalesce(len(sellers), 0) > 0 OR coalesce(ofs = 0, false) AS known) sellers_known),
c AS (SELECT *, CASE WHEN eps > 0 THEN price_band_high / eps END AS pe, CASE WHEN net_worth + coalesce(fresh_issue, 0) > 0 THEN mcap / (net_worth + coalesce(fresh_issue, 0)) END AS pb, CASE WHEN ebitda > 0 THEN (mcap + total_debt - cash_and_equivalents) / ebitda END AS ev, CASE WHEN revenue > 0 THEN mcap / revenue END AS ps,
  CASE WHEN pat > 0 AND pat_2 > 0 THEN (pow(pat / pat_2, 0.5) - 1) * 100 END AS pat_growth, CASE WHEN receivable_days_1 <> 0 THEN (receivable_days / receivable_days_1 - 1) * 100 END AS days_growth,
  CASE WHEN years > 0 AND {_known('cfo_l', 'pat_l')} THEN list_sum(list_transform(cfo_l, lambda v: CAST(v AS DECIMAL(30, 6)))) END AS cfo_sum, CASE WHEN years > 0 AND {_known('cfo_l', 'pat_l')} THEN list_sum(list_transform(pat_l, lambda v: CAST(v AS DECIMAL(30, 6)))) END AS pat_sum FROM b),
d AS (SELECT *, CASE WHEN pat_sum > 0 THEN CAST(cfo_sum AS DOUBLE) / CAST(pat_sum AS DOUBLE) END AS cfo_pat,
  coalesce(promoter_post_disclosed, CASE WHEN known AND pre_issue_shares > 0 AND shares > 0 AND promoter_pre_pct / 100 * pre_issue_shares - {_of(_PROMOTERS, 'shares_sold')} >= 0
    AND len(list_filter(coalesce(sellers, []), lambda s: s.type IN ({_PROMOTERS}) AND (s.shares_sold IS NULL OR coalesce(s.pre_issue_shares >= 0 AND s.shares_sold > s.pre_issue_shares + 1e-6, false)))) = 0
    THEN (promoter_pre_pct / 100 * pre_issue_shares - {_of(_PROMOTERS, 'shares_sold')}) / shares * 100 END) AS promoter_after,
  CASE WHEN fresh_issue > 0 AND len(proceeds) > 0 AND NOT (len(list_filter(proceeds, lambda x: x.amount IS NULL)) = 0 AND list_sum(list_transform(proceeds, lambda x: x.amount)) > fresh_issue * 1.001) THEN
    CASE WHEN ({_category('gcp')} + {_category('acquisition_unidentified')}) / fresh_issue * 100 > 20 THEN 'blind_heavy' WHEN {_category('gcp')} + {_category('acquisition_unidentified')} IS NULL THEN NULL
      WHEN {_category('debt_repayment')} / fresh_issue * 100 > 50 THEN 'debt_heavy' WHEN {_category('debt_repayment')} IS NULL THEN NULL
      WHEN ({_category('growth_capex')} + {_category('rnd')}) / fresh_issue * 100 >= 75 THEN 'growth' WHEN {_category('growth_capex')} + {_category('rnd')} IS NULL THEN NULL ELSE 'mixed_ok' END END AS use_bucket FROM c)
"""


def _cagr(field: str, years: int) -> tuple[str, str]:
    end, start = field, f"{field}_{years}"
    return f"CASE WHEN {end} > 0 AND {start} > 0 THEN (pow({end} / {start}, 1.0 / {years}) - 1) * 100 END", f"{end} IS NOT NULL AND {start} IS NOT NULL AND ({end} <= 0 OR {start} <= 0)"


def _premium(value: str, base: str) -> str:
    return f"CASE WHEN {base} <> 0 THEN ({value} - {base}) * 100 / {base} END"


_FIVE = lambda field: f"CASE WHEN years >= 5 AND {_known(f'list_slice({field}_l, -5, -1)')} THEN list_sum(list_slice({field}_l, -5, -1)) / 5 END"
_NEAR = "list_filter(coalesce(placements, []), lambda p: CAST(p.date AS DATE) BETWEEN CAST(open_date AS DATE) - 365 AND CAST(open_date AS DATE))"
#: By group: each metric's rule in SQL or, with a state of its own, its rule and when it is NOT_APPLICABLE.
RULES: dict[str, dict[str, str | tuple[str, str]]] = {
    "growth": {
        "pat_latest": "pat", "net_worth_latest": "net_worth", "revenue_cagr_2y_from_3fy": _cagr("revenue", 2), "revenue_cagr_3y_from_4fy": _cagr("revenue", 3), "pat_cagr_2y_from_3fy": _cagr("pat", 2),
        "margin_trend": _trend("em", "pm"), "margin_trend_5y_avg": f"CASE WHEN years >= 5 THEN {_trend('list_slice(em, -5, -1)', 'list_slice(pm, -5, -1)')} END",
        "roce_latest": ("coalesce(disclosed_roce_pct, CASE WHEN net_worth + total_debt > 0 THEN ebit / (net_worth + total_debt) * 100 END)", "disclosed_roce_pct IS NULL AND ebit IS NOT NULL AND net_worth + total_debt <= 0"),
        "cfo_pat_cumulative": ("cfo_pat", "pat_sum <= 0"),
        "leverage_bucket": "CASE WHEN net_worth > 0 AND total_debt IS NOT NULL THEN CASE WHEN total_debt / net_worth < 0.5 THEN CASE WHEN interest_expense = 0 AND total_debt = 0 THEN 'strong' WHEN interest_expense > 0 AND coalesce(ebit, ebitda) / interest_expense > 5 THEN 'strong' WHEN interest_expense > 0 AND coalesce(ebit, ebitda) IS NOT NULL THEN 'ok' END WHEN total_debt / net_worth < 1 THEN 'ok' WHEN total_debt / net_worth <= 2 THEN 'stretched' ELSE 'weak' END END",
        "low_base_year": "pm[1] < 0.5 * pm[-1]", "profit_declining": "CASE WHEN pat IS NOT NULL AND pat_1 IS NOT NULL THEN pat < pat_1 OR coalesce(pat_growth < 0, false) END",
        "margin_spike_pre_ipo": f"CASE WHEN years >= 3 AND {_known('em')} THEN (em[-1] - em[-2]) * 100 > 500 OR (em[-2] - em[-3]) * 100 > 500 END",
        "receivable_days_yoy_pct": ("days_growth", "receivable_days IS NOT NULL AND receivable_days_1 = 0"),
        "cfo_exempt": "CASE WHEN cfo_pat >= 0 THEN false WHEN cfo_pat < 0 AND days_growth IS NOT NULL THEN (coalesce(revenue > 0 AND order_book >= 2 * revenue, false) OR coalesce(collections >= pre_sales, false)) AND days_growth < 15 END",
        "contingent_liab_pct_networth": ("CASE WHEN net_worth > 0 THEN contingent_liabilities / net_worth * 100 END", "contingent_liabilities IS NOT NULL AND net_worth <= 0"),
    },
    "valuation": {
        "post_issue_shares_used": "shares", "market_cap_used": "mcap", "eps_used": "eps", "pe_used": ("pe", "eps <= 0"), "pb_used": "pb", "ev_ebitda_used": "ev", "ps_used": "ps",
        "pe_premium_pct": (_premium("pe", "mpe"), "eps <= 0"), "second_multiple_premium_pct": f"coalesce({_premium('ev', 'mev')}, {_premium('pb', 'mpb')})",
        "pb_roe_adjusted_premium_pct": _premium("pb", "(mpb * (CASE WHEN mroe <> 0 THEN roe_pct / mroe END))"), "ps_premium_pct": _premium("ps", "mps"),
        "peg": ("CASE WHEN pat_growth > 0 THEN pe / pat_growth END", f"coalesce({_cagr('pat', 2)[1]}, false) OR coalesce(pat_growth <= 0, false) OR coalesce(eps <= 0, false)"),
        "sector_ipo_relative": f"CASE WHEN {_premium('pe', 'list_aggregate(sector_ipos, $$median$$)')} < -10 THEN 'cheaper' WHEN {_premium('pe', 'list_aggregate(sector_ipos, $$median$$)')} > 10 THEN 'richer' WHEN {_premium('pe', 'list_aggregate(sector_ipos, $$median$$)')} IS NOT NULL THEN 'in_line' END",
        "pe_premium_mid_cycle_pct": _premium(f"(CASE WHEN {_FIVE('pat')} > 0 THEN price_band_high / ({_FIVE('pat')} * 1e7 / post_issue_shares) END)", "mpe"),
        "ev_ebitda_mid_cycle_premium_pct": _premium(f"(CASE WHEN {_FIVE('ebitda')} > 0 THEN (mcap + total_debt - cash_and_equivalents) / {_FIVE('ebitda')} END)", "mev"),
    },
    "offer": {
        "fresh_share_pct": ("CASE WHEN fresh_issue + ofs > 0 THEN fresh_issue / (fresh_issue + ofs) * 100 END", "fresh_issue + ofs <= 0"), "ofs_share_pct": ("CASE WHEN fresh_issue + ofs > 0 THEN ofs / (fresh_issue + ofs) * 100 END", "fresh_issue + ofs <= 0"), "pure_ofs": "fresh_issue = 0",
        "ofs_seller_bucket": f"CASE WHEN known THEN CASE WHEN {_of(_PROMOTERS, 'shares_sold')} > 0 THEN 'promoter_selling' WHEN len(list_filter(sellers, lambda s: s.type = 'pe_vc' AND s.pre_issue_shares > 0 AND s.shares_sold / s.pre_issue_shares >= 0.25)) > 0 THEN 'pe_vc_exit' ELSE 'none_or_small' END END",
        **{name: f"CASE WHEN known THEN CASE WHEN coalesce(len(list_filter(sellers, lambda s: s.type IN ({kinds}))), 0) = 0 THEN 0 WHEN {_of(kinds, 'pre_issue_shares')} > 0 THEN {_of(kinds, 'shares_sold')} / {_of(kinds, 'pre_issue_shares')} * 100 END END" for name, kinds in (("promoter_ofs_pct_of_holding", _PROMOTERS), ("pe_promoter_sold_pct_combined", _PROMOTERS + ", 'pe_vc'"))},
        "promoter_full_exit": "promoter_post_disclosed = 0", "promoter_post_pct": "promoter_after", "dilution_pct": "CASE WHEN shares > 0 THEN fresh_shares / shares * 100 END", "dilution_ok": "(CASE WHEN shares > 0 THEN fresh_shares / shares * 100 END) < 25 OR use_bucket = 'growth'",
        "gcp_amount": f"CASE WHEN proceeds IS NOT NULL THEN {_category('gcp')} END", "gcp_legal_max": "fresh_issue * 0.25", "use_of_proceeds_bucket": ("use_bucket", "fresh_issue = 0"),
        "pre_ipo_placement_bucket": f"CASE WHEN coalesce(len(placements), 0) = 0 THEN CASE WHEN placement_coverage IS NULL OR placement_coverage IN ('VERIFIED_NIL', 'DISCLOSED') THEN 'none_or_near_ipo' END WHEN price_band_high IS NOT NULL AND open_date IS NOT NULL AND len(list_filter({_NEAR}, lambda p: p.price IS NULL)) = 0 THEN CASE WHEN len(list_filter({_NEAR}, lambda p: p.price < 0.75 * price_band_high)) > 0 THEN 'deep_discount_12m' WHEN len(list_filter({_NEAR}, lambda p: p.price < 0.9 * price_band_high)) = 0 THEN 'none_or_near_ipo' ELSE 'in_between' END END",
        "lockin_bucket": "CASE WHEN promoter_lockin_in_place IS NOT NULL AND large_holders_unlocked_early IS NOT NULL THEN CASE WHEN promoter_lockin_in_place AND NOT large_holders_unlocked_early THEN 'intact' ELSE 'weak' END END",
    },
    "governance": {
        **{n: n for n in "litigation_bucket rpt_pct_revenue rpt_pct_of_revenue_growth eom_materiality auditor_opinion going_concern_uncertainty sebi_ed_action_active promoter_pledge_pct contingent_liab_unquantified adjusted_metrics_unreconciled heavy_discounted_allotments_18m auditor_or_cfo_exit_2y regulatory_dependence moat_rating visibility_rating loss_making_segments_present material_regulatory_disputes_present".split()},
        "auditor_bucket": ("CASE WHEN auditor_opinion NOT IN ('qualified', 'adverse', 'disclaimer') AND auditor_changed_3y IS NOT NULL THEN CASE WHEN auditor_changed_3y OR repeated_eom IS TRUE THEN 'unstable_or_repeated_eom' WHEN auditor_opinion = 'unqualified' AND auditor_reputed IS TRUE THEN 'clean_reputed' WHEN auditor_opinion = 'emphasis_of_matter' OR (auditor_opinion = 'unqualified' AND auditor_reputed IS FALSE) THEN 'eom_only' END END", "auditor_opinion IN ('qualified', 'adverse', 'disclaimer')"),
        "board_kmp_bucket": "CASE WHEN kmp_exits_2y >= 2 THEN 'high_churn' WHEN kmp_exits_2y IS NULL OR board_independent_majority IS NULL THEN NULL WHEN kmp_exits_2y = 0 AND board_independent_majority THEN 'independent_stable' ELSE 'other' END",
        "low_pre_issue_promoter_holding": "CASE WHEN pre_issue_promoter_holding_pct IS NOT NULL THEN pre_issue_promoter_holding_pct < 20 AND professionally_managed IS NOT TRUE END",
        "cash_flow_quality_below_50pct": ("CASE WHEN net_income_3yr > 0 THEN operating_cash_flow_3yr / net_income_3yr < 0.5 END", "operating_cash_flow_3yr IS NOT NULL AND net_income_3yr <= 0"),
        "dso_above_120_or_spike": "CASE WHEN trade_receivables_days IS NOT NULL THEN trade_receivables_days > 120 OR coalesce(receivable_days_1 > 0 AND receivable_days / receivable_days_1 > 1.25, false) END",
        **{f"dso_above_{x}": f"trade_receivables_days > {x}" for x in (60, 90)}, **{f"working_capital_above_{x}": f"net_working_capital_pct_revenue > {x}" for x in (20, 35, 50)},
        "promoter_pledge_upto_25": "promoter_pledged_shares_pct > 0 AND promoter_pledged_shares_pct <= 25", "promoter_pledge_25_to_50": "promoter_pledged_shares_pct > 25 AND promoter_pledged_shares_pct <= 50", "promoter_pledge_above_50": "promoter_pledged_shares_pct > 50",
        "top_customer_concentration_25_to_50": "top_customer_revenue_pct > 25 AND top_customer_revenue_pct <= 50", "top_customer_concentration_above_50": "top_customer_revenue_pct > 50",
        "contingent_liabilities_10_to_25": "contingent_liabilities_pct_net_worth > 10 AND contingent_liabilities_pct_net_worth <= 25", "contingent_liabilities_above_25": "contingent_liabilities_pct_net_worth > 25",
    },
    "market": {
        "industry_cagr_pct": "CASE WHEN industry_scope IS NOT NULL AND industry_forecast_period IS NOT NULL AND industry_source IS NOT NULL THEN industry_cagr END", "top5_concentration_pct": "greatest(top5_customer_pct, top5_supplier_pct)",
        "market_regime_variant": "CASE WHEN len(list_filter(list_slice(coalesce(listing_gains, []), -5, -1), lambda g: g > 20)) >= 3 THEN 'hot' ELSE 'normal' END",
        "retail_or_nii_below_1x": "CASE WHEN subscription_fresh AND retail_x IS NOT NULL AND nii_x IS NOT NULL THEN retail_x < 1 OR nii_x < 1 END", "qib_quota_pct": "qib_quota_pct",
        **{name: f"CASE WHEN {fresh} THEN {source} END" for name, source, fresh in (("anchor_bucket", "anchor_quality", "anchor_fresh"), ("qib_x", "qib_x", "subscription_fresh"), ("nii_x", "nii_x", "subscription_fresh"), ("overall_x", "overall_x", "subscription_fresh"), ("gmp_bucket", "gmp_trend", "gmp_fresh"), ("market_regime_bucket", "market_trend", "regime_fresh"))},
    },
    "sector": {
        "nim_cost_income_bucket": f"CASE WHEN years >= 2 AND {_known('nim_pct_l', 'cost_to_income_pct_l')} THEN CASE WHEN nim_pct > nim_pct_1 AND cost_to_income_pct < cost_to_income_pct_1 THEN 'improving' WHEN nim_pct < nim_pct_1 AND cost_to_income_pct > cost_to_income_pct_1 THEN 'deteriorating' WHEN (nim_pct > nim_pct_1 AND cost_to_income_pct > cost_to_income_pct_1) OR (nim_pct < nim_pct_1 AND cost_to_income_pct < cost_to_income_pct_1) OR (nim_pct = nim_pct_1 AND cost_to_income_pct = cost_to_income_pct_1) THEN 'stable' ELSE 'mixed' END END",
        "roa_roe_peer_quartile": "CASE WHEN nroe >= 2 AND coalesce(roe_pct, CASE WHEN net_worth > 0 THEN pat / net_worth * 100 END) IS NOT NULL THEN CASE WHEN coalesce(roe_pct, pat / net_worth * 100) >= mroe AND coalesce(roe_pct, pat / net_worth * 100) >= hroe - (hroe - mroe) / 2 THEN 'top_quartile' WHEN coalesce(roe_pct, pat / net_worth * 100) >= lroe THEN 'median' ELSE 'bottom_half' END END",
        "asset_quality_bucket": f"CASE WHEN years >= 2 AND {_known('gnpa_pct_l')} THEN CASE WHEN gnpa_pct > gnpa_pct_1 * 1.1 THEN CASE WHEN gnpa_pct > 5 THEN 'stressed' ELSE 'deteriorating' END WHEN gnpa_pct < gnpa_pct_1 AND coalesce(provision_coverage_pct, 0) >= coalesce(provision_coverage_pct_1, 0) THEN 'improving_strong' ELSE 'stable' END END",
        "crar_buffer_pts": "coalesce(crar_pct, tier1_pct) - coalesce(crar_minimum_pct, 15)", "cash_runway_months": ("CASE WHEN cfo < 0 THEN (cash_and_equivalents + coalesce(fresh_issue, 0)) / (-cfo / 12) END", "cash_and_equivalents IS NOT NULL AND cfo >= 0"),
        "net_debt_bucket": "CASE WHEN years >= 2 AND net_worth > 0 THEN CASE WHEN (total_debt - cash_and_equivalents) / net_worth < 0.5 THEN 'strong' WHEN (total_debt - cash_and_equivalents) / net_worth < 1 THEN 'ok' WHEN net_worth_1 > 0 AND (total_debt - cash_and_equivalents) / net_worth < (total_debt_1 - cash_and_equivalents_1) / net_worth_1 THEN 'ok' WHEN (total_debt - cash_and_equivalents) / net_worth <= 2 THEN 'stretched' WHEN (total_debt - cash_and_equivalents) / net_worth > 2 THEN 'weak' END END",
        "contribution_bucket": "CASE WHEN contribution_margin_pct IS NOT NULL AND contribution_margin_pct_1 IS NOT NULL AND contribution_margin_pct_2 IS NOT NULL THEN CASE WHEN contribution_margin_pct <= 0 THEN 'negative' WHEN contribution_margin_pct - contribution_margin_pct_1 > 3 AND contribution_margin_pct_1 - contribution_margin_pct_2 > 3 THEN 'expanding_2y_gt300bps' WHEN contribution_margin_pct > contribution_margin_pct_1 THEN 'positive_improving' ELSE 'positive_flat_or_falling' END END",
        "loss_narrowing_bucket": "CASE WHEN operating_loss_pct_revenue IS NOT NULL AND operating_loss_pct_revenue_1 IS NOT NULL AND operating_loss_pct_revenue_2 IS NOT NULL THEN CASE WHEN operating_loss_pct_revenue < operating_loss_pct_revenue_1 AND operating_loss_pct_revenue_1 < operating_loss_pct_revenue_2 THEN 'two_years' WHEN operating_loss_pct_revenue < operating_loss_pct_revenue_1 THEN 'one_year' ELSE 'widening' END END",
    },
}
TEXTS = set(metrics.DOMAINS) | set("litigation_bucket eom_materiality auditor_opinion moat_rating visibility_rating anchor_bucket gmp_bucket market_regime_bucket".split())
FLAGS = set("low_base_year profit_declining margin_spike_pre_ipo cfo_exempt pure_ofs promoter_full_exit dilution_ok retail_or_nii_below_1x going_concern_uncertainty sebi_ed_action_active contingent_liab_unquantified adjusted_metrics_unreconciled heavy_discounted_allotments_18m auditor_or_cfo_exit_2y regulatory_dependence loss_making_segments_present material_regulatory_disputes_present low_pre_issue_promoter_holding cash_flow_quality_below_50pct dso_above_60 dso_above_90 dso_above_120_or_spike working_capital_above_20 working_capital_above_35 working_capital_above_50 promoter_pledge_upto_25 promoter_pledge_25_to_50 promoter_pledge_above_50 top_customer_concentration_25_to_50 top_customer_concentration_above_50 contingent_liabilities_10_to_25 contingent_liabilities_above_25".split())


def _sql(group: str) -> str:
    columns = []
    for name, rule in RULES[group].items():
        value, na = rule if isinstance(rule, tuple) else (rule, None)
        columns.append(f"{value} AS {name}" if name in TEXTS | FLAGS else f"floor(({value}) * 1e4 + 0.5) / 1e4 AS {name}")
        if na:
            columns.append(f"CASE WHEN ({value}) IS NOT NULL THEN 'VALUE' WHEN {na} THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END AS {name}_state")
    return f"{RICH} SELECT ipo_id, {', '.join(columns)} FROM d"


def _register(group: str) -> None:
    @query(f"metrics_{group}", _sql(group))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = list(RULES[group])
        made = metrics.derive(issuers(spark, sf_dir), names)
        told = [F.col(n) if n in TEXTS | FLAGS else places(F.col(n), 4).alias(n) for n in names]
        return made.select("ipo_id", *told, *[metrics.state(n).alias(f"{n}_state") for n in names if isinstance(RULES[group][n], tuple)])


for _group in RULES:
    _register(_group)


def _states(name: str, rule: str | tuple[str, str]) -> str:
    value, na = rule if isinstance(rule, tuple) else (rule, "false")
    kind = "boolean" if name in FLAGS else "categorical" if name in TEXTS else "numeric"
    return f"SELECT '{name}' AS metric_id, CASE WHEN ({value}) IS NOT NULL THEN 'VALUE' WHEN {na} THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END AS state, '{kind}' AS kind, count(*) AS n FROM d GROUP BY 2"


@query("metrics_all_states", RICH.replace("\nd AS (", "\nd AS MATERIALIZED (") + " UNION ALL ".join(_states(n, r) for rules_ in RULES.values() for n, r in rules_.items()))
def metrics_all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many issuers have each state of each metric."""
    names = list(metrics.REGISTRY)
    return metrics.long_form(metrics.derive(issuers(spark, sf_dir), names), "ipo_id", names).groupBy("metric_id", "state", "kind").agg(F.count(F.lit(1)).alias("n"))
