"""Entry points: evaluate input documents under a policy, and replay what was stored.

An input document is JSON text of nested sections (issue, capital_structure,
financials, use_of_proceeds, governance, business, market, peers, ...). Documents
become rows of issues, so one or a great many are the same plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import hashing, metrics, policy, rules, text
from quillmark.sources.documents import strict_json

#: Where a document tells each scalar column; money among them is scaled from the document's unit.
PATHS = {
    "fresh_issue": "issue.fresh_issue", "ofs": "issue.ofs", "fresh_shares": "issue.fresh_shares", "ofs_shares": "issue.ofs_shares", "pre_issue_shares": "issue.pre_issue_shares", "post_issue_shares": "issue.post_issue_shares",
    "post_issue_eps": "issue.post_issue_eps", "price_band_high": "issue.price_band_high", "open_date": "issue.open_date", "qib_quota_pct": "issue.quota_pct.qib",
    "promoter_pre_pct": "capital_structure.promoter_pre_pct", "promoter_post_disclosed": "capital_structure.promoter_post_pct", "promoter_pledge_pct": "capital_structure.promoter_pledge_pct",
    "contingent_liabilities": "financials.contingent_liabilities", "crar_minimum_pct": "financials.regulatory_crar_min_pct", "trade_receivables_days": "financials.trade_receivables_days", "net_working_capital_pct_revenue": "financials.net_working_capital_pct_revenue", "top_customer_revenue_pct": "financials.top_customer_revenue_pct",
    "kmp_exits_2y": "governance.kmp_exits_2y", "auditor_opinion": "governance.auditor_opinion", "litigation_bucket": "governance.litigation_bucket", "eom_materiality": "governance.eom_materiality", "auditor_changed_3y": "governance.auditor_changed_3y", "auditor_reputed": "governance.auditor_reputed",
    "repeated_eom": "governance.repeated_eom", "board_independent_majority": "governance.board_independent_majority", "going_concern_uncertainty": "governance.going_concern_uncertainty", "rpt_pct_revenue": "governance.rpt_pct_revenue",
    "moat_rating": "business.moat_rating", "visibility_rating": "business.visibility_rating", "top5_customer_pct": "business.top5_customer_pct", "top5_supplier_pct": "business.top5_supplier_pct",
    "qib_x": "market.subscription.qib_x", "nii_x": "market.subscription.nii_x", "retail_x": "market.subscription.retail_x", "overall_x": "market.subscription.overall_x", "anchor_quality": "market.anchor.quality", "gmp_trend": "market.gmp.trend", "market_trend": "market.regime.nifty_trend",
    "subscription_fresh": "market.subscription.fresh", "anchor_fresh": "market.anchor.fresh", "gmp_fresh": "market.gmp.fresh", "regime_fresh": "market.regime.fresh",
}
LISTS = {"periods": "financials.periods", "sellers": "issue.ofs_sellers", "proceeds": "use_of_proceeds", "placements": "capital_structure.pre_ipo_placements", "peers": "peers", "sector_ipos": "market.sector_ipos", "listing_gains": "market.last_five_listing_gains"}
#: Money, of a document and of its periods.
MONEY = ("fresh_issue", "ofs", "contingent_liabilities")
PERIOD_MONEY = "revenue ebitda ebit pat pbt tax net_worth total_debt interest_expense finance_cost depreciation other_income cfo capex cash_and_equivalents trade_receivables inventory order_book pre_sales collections".split()


def issues(documents: DataFrame, key: str = "ipo_id", document: str = "document") -> DataFrame:
    """(key and the columns that metrics read) of JSON documents; amounts in crore, by the document's reporting unit (crore, if it tells none)."""
    kinds = {c: t for t, names in metrics.SCALARS.items() for c in names}
    told = lambda path: F.get_json_object(F.col(document), f"$.{path}")
    factor = text.in_crore(F.lit(1.0), F.coalesce(told("financials.reporting_unit"), F.lit("INR_CRORES")))
    given = documents.select(key, document, factor.alias("__factor"))
    out = given.select(key, "__factor", *[told(p).try_cast(kinds[c]).alias(c) for c, p in PATHS.items()], *[F.from_json(told(p), metrics.ARRAYS[c]).alias(c) for c, p in LISTS.items()])

    def scaled(p: Column, fields: list[str], money: Sequence[str]) -> Column:
        return F.struct(*[(p[f] * F.col("__factor") if f in money else p[f]).alias(f) for f in fields])

    periods = F.transform("periods", lambda p: scaled(p, ["fy", "is_stub", *metrics.PERIOD_FIELDS], PERIOD_MONEY))
    proceeds = F.transform("proceeds", lambda p: scaled(p, ["category", "amount"], ["amount"]))
    return out.withColumns({**{c: F.col(c) * F.col("__factor") for c in MONEY}, "periods": periods, "proceeds": proceeds}).drop("__factor")


def load_config(source: str | Mapping[str, Any]) -> dict[str, Any]:
    """A policy from a mapping or a local JSON file; one with faults is refused."""
    spec = dict(source) if isinstance(source, Mapping) else strict_json(Path(source).read_text(encoding="utf-8"))
    if faults := policy.findings(spec):
        raise ValueError("; ".join(f"{code} at {at}" for code, at, _ in faults))
    return spec


def names(spec: Mapping[str, Any]) -> list[str]:
    """The metrics that a policy asks for, in any part of it."""
    found: set[str] = set()

    def walk(part: Any) -> None:
        if isinstance(part, Mapping):
            found.update(str(part[k]) for k in ("metric", "flag", "variant_metric") if k in part)
            for value in part.values():
                walk(value)
        elif isinstance(part, (list, tuple)):
            for value in part:
                walk(value)

    walk(spec)
    for knockout in spec.get("knockouts", []):
        found.update(knockout.get("required", []))
    found.update(spec.get("critical_data", {}).get("items", []))
    return [n for n in metrics.REGISTRY if n in found]


def evaluate(documents: DataFrame, spec: Mapping[str, Any], key: str = "ipo_id", document: str = "document", profile: Column | None = None, mode: str = "final", overrides: dict[str, Column] | None = None) -> DataFrame:
    """The evaluation of each document: scores, bounds, completeness, knockouts, verdict, its plan, and digests of the document and of the result."""
    derived = metrics.derive(issues(documents, key, document), names(spec), overrides)
    made = rules.evaluate_planned(derived, key, spec, profile, mode)
    inputs = documents.select(F.col(key).alias("__k"), hashing.json_digest(F.col(document)).alias("input_hash"))
    out = made.join(inputs, made[key] == inputs["__k"]).drop("__k")
    return out.withColumn("result_hash", hashing.json_digest(F.to_json(F.struct(*[c for c in out.columns if c != "input_hash"]), {"ignoreNullFields": "false"}), wrapped=False))


def evaluate_file(spark: SparkSession, path: str, spec: Mapping[str, Any], ipo_id: str) -> DataFrame:
    """The evaluation of one local document; repeated keys in it are an error."""
    raw = Path(path).read_text(encoding="utf-8")
    strict_json(raw)
    return evaluate(spark.createDataFrame([(ipo_id, raw)], "ipo_id string, document string"), spec)


def replay(documents: DataFrame, spec: Mapping[str, Any], stored: DataFrame, key: str = "ipo_id") -> DataFrame:
    """(key, input_matches, result_matches): stored evaluations against the documents evaluated again."""
    again = evaluate(documents, spec, key).select(F.col(key).alias("__k"), F.col("input_hash").alias("__i"), F.col("result_hash").alias("__r"))
    met = stored.join(again, stored[key] == again["__k"], "left")
    return met.select(key, F.col("input_hash").eqNullSafe(F.col("__i")).alias("input_matches"), F.col("result_hash").eqNullSafe(F.col("__r")).alias("result_matches"))
