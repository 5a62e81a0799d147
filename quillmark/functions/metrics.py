"""The registry of derived metrics: name -> column.

An issue is a row: `periods` (array of structs, oldest first), arrays `sellers`,
`proceeds`, `placements`, `peers`, `sector_ipos`, and scalar columns. A metric
gives its value, null where it is unknown, and whether it is NOT_APPLICABLE;
`derive` adds both, as <name> and <name>__na, in layers so that no projection
grows without bound. Absence is never taken for 0. Thresholds are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Made = Column | tuple[Column, Column]
REGISTRY: dict[str, Callable[[], Made]] = {}

PERIOD_FIELDS = (
    "revenue ebitda ebit pat pbt tax net_worth total_debt interest_expense finance_cost depreciation other_income cfo capex cash_and_equivalents trade_receivables inventory order_book pre_sales collections "
    "receivable_days disclosed_roce_pct contribution_margin_pct operating_loss_pct_revenue nim_pct cost_to_income_pct gnpa_pct nnpa_pct provision_coverage_pct crar_pct tier1_pct roa_pct roe_pct"
).split()
PERIOD_TYPE = "array<struct<fy:string,is_stub:boolean," + ",".join(f"{f}:double" for f in PERIOD_FIELDS) + ">>"
#: Scalar columns of an issue, by type.
SCALARS = {
    "double": "fresh_issue ofs fresh_shares ofs_shares pre_issue_shares post_issue_shares post_issue_eps price_band_high market_cap promoter_pre_pct promoter_post_disclosed promoter_pledge_pct rpt_pct_revenue rpt_pct_of_revenue_growth industry_cagr top5_customer_pct operating_cash_flow_3yr net_income_3yr trade_receivables_days net_working_capital_pct_revenue promoter_pledged_shares_pct pre_issue_promoter_holding_pct top_customer_revenue_pct contingent_liabilities_pct_net_worth top5_supplier_pct contingent_liabilities qib_quota_pct qib_x nii_x retail_x overall_x kmp_exits_2y crar_minimum_pct".split(),
    "string": "auditor_opinion litigation_bucket eom_materiality industry_scope industry_forecast_period industry_source moat_rating visibility_rating anchor_quality gmp_trend market_trend open_date placement_coverage".split(),
    "boolean": "professionally_managed loss_making_segments_present material_regulatory_disputes_present promoter_lockin_in_place large_holders_unlocked_early auditor_changed_3y auditor_reputed repeated_eom board_independent_majority going_concern_uncertainty sebi_ed_action_active auditor_or_cfo_exit_2y regulatory_dependence contingent_liab_unquantified adjusted_metrics_unreconciled heavy_discounted_allotments_18m anchor_fresh subscription_fresh gmp_fresh regime_fresh".split(),
}
ARRAYS = {
    "periods": PERIOD_TYPE,
    "sellers": "array<struct<type:string,pre_issue_shares:double,shares_sold:double>>",
    "proceeds": "array<struct<category:string,amount:double>>",
    "placements": "array<struct<date:string,price:double>>",
    "peers": "array<struct<pe:double,ev_ebitda:double,pb:double,ps:double,roe_pct:double,roa_pct:double>>",
    "sector_ipos": "array<double>",
    "listing_gains": "array<double>",
}


def complete(issues: DataFrame) -> DataFrame:
    """`issues` with every column that the metrics read; those that aren't there are unknown."""
    have = set(issues.columns)
    wanted = {**{c: t for t, cs in SCALARS.items() for c in cs}, **ARRAYS}
    return issues.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in have})


def metric(name: str):
    def keep(f):
        REGISTRY[name] = f
        return f

    return keep


def full_years() -> Column:
    return F.filter(F.coalesce("periods", F.array().cast(PERIOD_TYPE)), lambda p: ~F.coalesce(p["is_stub"], F.lit(False)))


def at(field: str, back: int = 1) -> Column:
    """A field of the `back`-th last full year; null if there are fewer."""
    return F.try_element_at(full_years(), F.lit(-back))[field]


def series(field: str, last: int | None = None) -> Column:
    years = full_years()
    return F.transform(years if last is None else F.slice(years, F.greatest(F.lit(1), F.size(years) - last + 1), F.lit(last)), lambda p: p[field])


def all_known(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull())


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def deltas(values: Column) -> Column:
    return F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: b - a)


def median(values: Column) -> Column:
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(ordered)
    mid = F.floor(n / 2).cast("int")
    return F.when(n > 0, F.when(n % 2 == 1, F.get(ordered, mid)).otherwise((F.get(ordered, mid - 1) + F.get(ordered, mid)) / 2))


def peer_median(field: str) -> Column:
    return median(F.transform("peers", lambda p: p[field]))


def ratio_or_na(top: Column, bottom: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """top / bottom; a bottom of 0 or less makes it NOT_APPLICABLE."""
    known = top.isNotNull() & bottom.isNotNull()
    return F.when(known & (bottom > 0), top / bottom * scale), known & (bottom <= 0)


def premium(value: Column, base: Column) -> Column:
    return F.try_divide((value - base) * 100.0, base)


def _passed(name: str, source: str | None = None):
    REGISTRY[name] = lambda: F.col(source or name)


for _name in ("litigation_bucket rpt_pct_revenue rpt_pct_of_revenue_growth eom_materiality qib_quota_pct auditor_opinion going_concern_uncertainty sebi_ed_action_active promoter_pledge_pct contingent_liab_unquantified adjusted_metrics_unreconciled heavy_discounted_allotments_18m auditor_or_cfo_exit_2y regulatory_dependence moat_rating visibility_rating").split():
    _passed(_name)
for _name, _field in (("pat_latest", "pat"), ("net_worth_latest", "net_worth")):
    REGISTRY[_name] = lambda f=_field: at(f)


def _cagr(field: str, years: int) -> tuple[Column, Column]:
    end, start = at(field), at(field, years + 1)
    known = end.isNotNull() & start.isNotNull()
    return F.when(known & (end > 0) & (start > 0), (F.pow(end / start, F.lit(1.0 / years)) - 1) * 100.0), known & ((end <= 0) | (start <= 0))


for _name, _field, _years in (("revenue_cagr_2y_from_3fy", "revenue", 2), ("revenue_cagr_3y_from_4fy", "revenue", 3), ("pat_cagr_2y_from_3fy", "pat", 2)):
    REGISTRY[_name] = lambda f=_field, y=_years: _cagr(f, y)


def _trend(last: int | None) -> Column:
    margins = lambda top: F.transform(F.arrays_zip(series(top, last).alias("t"), series("revenue", last).alias("r")), lambda x: F.when(x["r"] != 0, x["t"] / x["r"] * 100.0))
    e, p = margins("ebitda"), margins("pat")
    de, dp = deltas(e), deltas(p)
    every = lambda d, test: F.forall(d, test)
    falling = every(de, lambda x: x < 0) & every(dp, lambda x: x < 0)
    rising = every(de, lambda x: x > 0) & every(dp, lambda x: x > 0)
    flips = F.exists(de, lambda x: x > 0) & F.exists(de, lambda x: x < 0) & (F.array_max(e) - F.array_min(e) > 3)
    known = all_known(e) & all_known(p) & (F.size(e) >= 2)
    return F.when(known, F.when((at("pat") <= 0) | falling, "declining_or_loss").when(rising, "expanding").when(flips, "volatile").otherwise("stable"))


REGISTRY["margin_trend"] = lambda: _trend(None)
REGISTRY["margin_trend_5y_avg"] = lambda: F.when(F.size(full_years()) >= 5, _trend(5))


@metric("roce_latest")
def _roce():
    capital = at("net_worth") + at("total_debt")
    value, na = ratio_or_na(at("ebit"), capital, 100.0)
    return F.coalesce(at("disclosed_roce_pct"), value), at("disclosed_roce_pct").isNull() & F.coalesce(na, F.lit(False))


@metric("cfo_pat_cumulative")
def _cfo_pat():
    exact = lambda f: F.aggregate(series(f), F.lit(0).cast("decimal(38,6)"), lambda a, v: (a + v.cast("decimal(30,6)")).cast("decimal(38,6)")).cast("double")
    known = (F.size(full_years()) > 0) & all_known(series("cfo")) & all_known(series("pat"))
    return F.when(known & (exact("pat") > 0), exact("cfo") / exact("pat")), known & (exact("pat") <= 0)


@metric("leverage_bucket")
def _leverage():
    debt, equity, interest = at("total_debt"), at("net_worth"), at("interest_expense")
    gearing = F.when(equity > 0, debt / equity)
    cover = F.when(interest > 0, F.coalesce(at("ebit"), at("ebitda")) / interest)
    # Below 0.5 the interest cover decides, and without it nothing does; only a debt-free year has none to cover.
    low = F.when((interest == 0) & (debt == 0), "strong").when(cover > 5, "strong").when(cover <= 5, "ok")
    return F.when(gearing < 0.5, low).when(gearing < 1, "ok").when(gearing <= 2, "stretched").when(gearing > 2, "weak")


def shares_after() -> Column:
    return F.coalesce(F.col("post_issue_shares"), F.col("pre_issue_shares") + F.col("fresh_shares"))


def cap_value() -> Column:
    return F.coalesce(F.col("market_cap"), F.col("price_band_high") * shares_after() / 1e7)


def earnings() -> Column:
    return F.coalesce(F.col("post_issue_eps"), F.when(shares_after() > 0, at("pat") * 1e7 / shares_after()))


def pe() -> Column:
    return F.when(earnings() > 0, F.col("price_band_high") / earnings())


def pb() -> Column:
    equity = at("net_worth") + F.coalesce("fresh_issue", F.lit(0.0))
    return F.when(equity > 0, cap_value() / equity)


def ev_ebitda() -> Column:
    return F.when(at("ebitda") > 0, (cap_value() + at("total_debt") - at("cash_and_equivalents")) / at("ebitda"))


REGISTRY["post_issue_shares_used"] = shares_after
REGISTRY["market_cap_used"] = cap_value
REGISTRY["eps_used"] = earnings
REGISTRY["pe_used"] = lambda: (pe(), earnings() <= 0)
REGISTRY["pb_used"] = pb
REGISTRY["ev_ebitda_used"] = ev_ebitda
REGISTRY["ps_used"] = lambda: F.when(at("revenue") > 0, cap_value() / at("revenue"))
REGISTRY["pe_premium_pct"] = lambda: (premium(pe(), peer_median("pe")), earnings() <= 0)
REGISTRY["second_multiple_premium_pct"] = lambda: F.coalesce(premium(ev_ebitda(), peer_median("ev_ebitda")), premium(pb(), peer_median("pb")))
REGISTRY["pb_roe_adjusted_premium_pct"] = lambda: premium(pb(), peer_median("pb") * F.try_divide(at("roe_pct"), peer_median("roe_pct")))
REGISTRY["ps_premium_pct"] = lambda: premium(REGISTRY["ps_used"](), peer_median("ps"))


@metric("peg")
def _peg():
    growth, na = _cagr("pat", 2)
    return F.when(growth > 0, pe() / growth), na | (growth <= 0) | (earnings() <= 0)


@metric("low_base_year")
def _low_base():
    first = F.get(full_years(), F.lit(0))
    margin = lambda pat, revenue: F.when(revenue != 0, pat / revenue)
    return margin(first["pat"], first["revenue"]) < 0.5 * margin(at("pat"), at("revenue"))


@metric("sector_ipo_relative")
def _sector():
    gap = premium(pe(), median(F.col("sector_ipos")))
    return F.when(gap < -10, "cheaper").when(gap > 10, "richer").when(gap.isNotNull(), "in_line")


def _five_year(field: str) -> Column:
    values = series(field, 5)
    return F.when((F.size(full_years()) >= 5) & all_known(values), summed(values) / 5)


REGISTRY["pe_premium_mid_cycle_pct"] = lambda: premium(F.when(_five_year("pat") > 0, F.col("price_band_high") / (_five_year("pat") * 1e7 / F.col("post_issue_shares"))), peer_median("pe"))
REGISTRY["ev_ebitda_mid_cycle_premium_pct"] = lambda: premium(F.when(_five_year("ebitda") > 0, (cap_value() + at("total_debt") - at("cash_and_equivalents")) / _five_year("ebitda")), peer_median("ev_ebitda"))
REGISTRY["fresh_share_pct"] = lambda: ratio_or_na(F.col("fresh_issue"), F.col("fresh_issue") + F.col("ofs"), 100.0)
REGISTRY["ofs_share_pct"] = lambda: ratio_or_na(F.col("ofs"), F.col("fresh_issue") + F.col("ofs"), 100.0)
REGISTRY["pure_ofs"] = lambda: F.col("fresh_issue") == 0


#: Sellers that count as promoters.
PROMOTERS = ("promoter", "promoter_group")


def _sellers(kinds: tuple[str, ...]) -> Column:
    return F.filter(F.coalesce("sellers", F.array().cast(ARRAYS["sellers"])), lambda s: s["type"].isin(*kinds))


def _shares(own: Column, field: str) -> Column:
    """Sum of a field of sellers; what isn't told adds nothing."""
    return summed(F.transform(own, lambda s: F.coalesce(s[field], F.lit(0.0))))


def sellers_known() -> Column:
    """An empty list of sellers tells something only where nothing is offered for sale."""
    return (F.coalesce(F.size("sellers"), F.lit(0)) > 0) | F.coalesce(F.col("ofs") == 0, F.lit(False))


@metric("ofs_seller_bucket")
def _seller():
    leaving = F.exists(_sellers(("pe_vc",)), lambda s: F.coalesce((s["pre_issue_shares"] > 0) & (s["shares_sold"] >= 0.25 * s["pre_issue_shares"]), F.lit(False)))
    return F.when(sellers_known(), F.when(_shares(_sellers(PROMOTERS), "shares_sold") > 0, "promoter_selling").when(leaving, "pe_vc_exit").otherwise("none_or_small"))


def _sold_share(kinds: tuple[str, ...]) -> Column:
    own = _sellers(kinds)
    held = _shares(own, "pre_issue_shares")
    return F.when(sellers_known(), F.when(F.size(own) == 0, 0.0).when(held > 0, _shares(own, "shares_sold") / held * 100.0))


REGISTRY["promoter_ofs_pct_of_holding"] = lambda: _sold_share(PROMOTERS)
REGISTRY["pe_promoter_sold_pct_combined"] = lambda: _sold_share((*PROMOTERS, "pe_vc"))


def promoter_after() -> Column:
    """Disclosed, or what was held before less what is sold, if every part is told and no more is sold than was held."""
    own = _sellers(PROMOTERS)
    left = F.col("promoter_pre_pct") / 100.0 * F.col("pre_issue_shares") - _shares(own, "shares_sold")
    told = F.forall(own, lambda s: s["shares_sold"].isNotNull() & ~F.coalesce((s["pre_issue_shares"] >= 0) & (s["shares_sold"] > s["pre_issue_shares"] + 1e-6), F.lit(False)))
    return F.coalesce(F.col("promoter_post_disclosed"), F.when(sellers_known() & told & (F.col("pre_issue_shares") > 0) & (shares_after() > 0) & (left >= 0), left / shares_after() * 100.0))


REGISTRY["promoter_post_pct"] = promoter_after
REGISTRY["promoter_full_exit"] = lambda: F.col("promoter_post_disclosed") == 0
REGISTRY["dilution_pct"] = lambda: F.when(shares_after() > 0, F.col("fresh_shares") / shares_after() * 100.0)


def _amount(test: Callable[[Column], Column]) -> Column:
    return summed(F.transform(F.filter("proceeds", lambda p: test(p["category"])), lambda p: p["amount"]))


@metric("use_of_proceeds_bucket")
def _use():
    fresh = F.col("fresh_issue")
    # A category with an untold amount is null; one that the schedule doesn't list is nil, as a schedule lists all.
    part = lambda kind: _amount(lambda c: c == kind) / fresh * 100.0
    blind, debt, growth = part("gcp") + part("acquisition_unidentified"), part("debt_repayment"), part("growth_capex") + part("rnd")
    settled = F.when(blind <= 20, F.when(debt > 50, "debt_heavy").when(debt <= 50, F.when(growth >= 75, "growth").when(growth < 75, "mixed_ok")))
    over = F.coalesce(_amount(lambda c: F.lit(True)) > fresh * 1.001, F.lit(False))
    return F.when((fresh > 0) & (F.size("proceeds") > 0) & ~over, F.when(blind > 20, "blind_heavy").otherwise(settled)), fresh == 0


REGISTRY["dilution_ok"] = lambda: (REGISTRY["dilution_pct"]() < 25) | (_use()[0] == "growth")
REGISTRY["gcp_amount"] = lambda: _amount(lambda c: c == "gcp")
REGISTRY["gcp_legal_max"] = lambda: F.col("fresh_issue") * 0.25


@metric("pre_ipo_placement_bucket")
def _placement():
    opened, price = F.to_date("open_date"), F.col("price_band_high")
    given = F.coalesce("placements", F.array().cast(ARRAYS["placements"]))
    near = F.filter(given, lambda p: F.coalesce(F.to_date(p["date"]).between(F.date_sub(opened, 365), opened), F.lit(False)))
    # An empty list is a nil that was read, unless the coverage says that it wasn't.
    nil = F.coalesce(F.col("placement_coverage").isin("VERIFIED_NIL", "DISCLOSED"), F.lit(True))
    known = opened.isNotNull() & price.isNotNull() & F.forall(near, lambda p: p["price"].isNotNull())
    judged = F.when(F.exists(near, lambda p: p["price"] < 0.75 * price), "deep_discount_12m").when(F.forall(near, lambda p: p["price"] >= 0.9 * price), "none_or_near_ipo").otherwise("in_between")
    return F.when(F.size(given) == 0, F.when(nil, "none_or_near_ipo")).when(known, judged)


REGISTRY["lockin_bucket"] = lambda: F.when(F.col("promoter_lockin_in_place").isNotNull() & F.col("large_holders_unlocked_early").isNotNull(), F.when(F.col("promoter_lockin_in_place") & ~F.col("large_holders_unlocked_early"), "intact").otherwise("weak"))


@metric("auditor_bucket")
def _auditor():
    opinion, changed, reputed = F.col("auditor_opinion"), F.col("auditor_changed_3y"), F.col("auditor_reputed")
    calm = F.when((opinion == "unqualified") & reputed, "clean_reputed").when((opinion == "emphasis_of_matter") | ((opinion == "unqualified") & reputed.isNotNull()), "eom_only")
    bad = opinion.isin("qualified", "adverse", "disclaimer")
    return F.when(~bad & changed.isNotNull(), F.when(changed | F.coalesce("repeated_eom", F.lit(False)), "unstable_or_repeated_eom").otherwise(calm)), F.coalesce(bad, F.lit(False))


REGISTRY["board_kmp_bucket"] = lambda: F.when(F.col("kmp_exits_2y") >= 2, "high_churn").when((F.col("kmp_exits_2y") == 0) & F.col("board_independent_majority"), "independent_stable").when(F.col("kmp_exits_2y").isNotNull() & F.col("board_independent_majority").isNotNull(), "other")
REGISTRY["industry_cagr_pct"] = lambda: F.when(F.col("industry_scope").isNotNull() & F.col("industry_forecast_period").isNotNull() & F.col("industry_source").isNotNull(), F.col("industry_cagr"))
REGISTRY["top5_concentration_pct"] = lambda: F.greatest("top5_customer_pct", "top5_supplier_pct")
REGISTRY["market_regime_variant"] = lambda: F.when(F.size(F.filter(F.slice(F.coalesce("listing_gains", F.array().cast("array<double>")), F.greatest(F.lit(1), F.size(F.coalesce("listing_gains", F.array().cast("array<double>"))) - 4), F.lit(5)), lambda g: g > 20)) >= 3, "hot").otherwise("normal")
REGISTRY["retail_or_nii_below_1x"] = lambda: F.when(F.col("retail_x").isNotNull() & F.col("nii_x").isNotNull() & F.col("subscription_fresh"), (F.col("retail_x") < 1) | (F.col("nii_x") < 1))
for _name, _field, _fresh in (("anchor_bucket", "anchor_quality", "anchor_fresh"), ("qib_x", "qib_x", "subscription_fresh"), ("nii_x", "nii_x", "subscription_fresh"), ("overall_x", "overall_x", "subscription_fresh"), ("gmp_bucket", "gmp_trend", "gmp_fresh"), ("market_regime_bucket", "market_trend", "regime_fresh")):
    REGISTRY[_name] = lambda f=_field, g=_fresh: F.when(F.col(g), F.col(f))


REGISTRY["profit_declining"] = lambda: (at("pat") < at("pat", 2)) | F.when(at("pat").isNotNull() & at("pat", 2).isNotNull(), F.coalesce(_cagr("pat", 2)[0] < 0, F.lit(False)))


@metric("margin_spike_pre_ipo")
def _spike():
    margins = F.transform(full_years(), lambda p: F.when(p["revenue"] != 0, p["ebitda"] / p["revenue"] * 100.0))
    last = F.slice(deltas(margins), -2, 2)
    return F.when((F.size(margins) >= 3) & all_known(margins), F.exists(last, lambda d: d * 100 > 500))


REGISTRY["receivable_days_yoy_pct"] = lambda: (F.when(at("receivable_days", 2) != 0, (at("receivable_days") / at("receivable_days", 2) - 1) * 100.0), at("receivable_days").isNotNull() & (at("receivable_days", 2) == 0))


@metric("cfo_exempt")
def _exempt():
    ratio, days = _cfo_pat()[0], REGISTRY["receivable_days_yoy_pct"]()[0]
    backed = F.coalesce((at("revenue") > 0) & (at("order_book") >= 2 * at("revenue")), F.lit(False)) | F.coalesce(at("collections") >= at("pre_sales"), F.lit(False))
    return F.when(ratio >= 0, False).when((ratio < 0) & days.isNotNull(), backed & (days < 15))


REGISTRY["contingent_liab_pct_networth"] = lambda: ratio_or_na(F.col("contingent_liabilities"), at("net_worth"), 100.0)


@metric("nim_cost_income_bucket")
def _nim():
    nim, cost = F.signum(at("nim_pct") - at("nim_pct", 2)), F.signum(at("cost_to_income_pct") - at("cost_to_income_pct", 2))
    known = (F.size(full_years()) >= 2) & all_known(series("nim_pct")) & all_known(series("cost_to_income_pct"))
    return F.when(known, F.when((nim > 0) & (cost < 0), "improving").when((nim < 0) & (cost > 0), "deteriorating").when(nim == cost, "stable").otherwise("mixed"))


@metric("roa_roe_peer_quartile")
def _returns():
    roe = F.coalesce(at("roe_pct"), F.when(at("net_worth") > 0, at("pat") / at("net_worth") * 100.0))
    known = F.filter(F.transform("peers", lambda p: p["roe_pct"]), lambda v: v.isNotNull())
    low, mid, high = F.array_min(known), median(known), F.array_max(known)
    return F.when((F.size(known) >= 2) & roe.isNotNull(), F.when((roe >= mid) & (roe >= high - (high - mid) / 2), "top_quartile").when(roe >= low, "median").otherwise("bottom_half"))


@metric("asset_quality_bucket")
def _assets():
    now, before = at("gnpa_pct"), at("gnpa_pct", 2)
    kept = F.coalesce(at("provision_coverage_pct"), F.lit(0.0)) >= F.coalesce(at("provision_coverage_pct", 2), F.lit(0.0))
    known = (F.size(full_years()) >= 2) & all_known(series("gnpa_pct"))
    return F.when(known, F.when(now > 1.1 * before, F.when(now > 5, "stressed").otherwise("deteriorating")).when((now < before) & kept, "improving_strong").otherwise("stable"))


REGISTRY["crar_buffer_pts"] = lambda: F.coalesce(at("crar_pct"), at("tier1_pct")) - F.coalesce("crar_minimum_pct", F.lit(15.0))
REGISTRY["cash_runway_months"] = lambda: (F.when(at("cfo") < 0, (at("cash_and_equivalents") + F.coalesce("fresh_issue", F.lit(0.0))) / (-at("cfo") / 12)), at("cash_and_equivalents").isNotNull() & (at("cfo") >= 0))


@metric("net_debt_bucket")
def _net_debt():
    level = lambda b: F.when(at("net_worth", b) > 0, (at("total_debt", b) - at("cash_and_equivalents", b)) / at("net_worth", b))
    now, better = level(1), F.coalesce(level(1) < level(2), F.lit(False))
    return F.when(F.size(full_years()) >= 2, F.when(now < 0.5, "strong").when((now < 1) | better, "ok").when(now <= 2, "stretched").when(now > 2, "weak"))


def _last_three(field: str, judge: Callable[[Column, Column, Column], Column]) -> Column:
    a, b, c = at(field, 3), at(field, 2), at(field)
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), judge(a, b, c))


REGISTRY["contribution_bucket"] = lambda: _last_three("contribution_margin_pct", lambda a, b, c: F.when(c <= 0, "negative").when((c - b > 3) & (b - a > 3), "expanding_2y_gt300bps").when(c > b, "positive_improving").otherwise("positive_flat_or_falling"))
REGISTRY["loss_narrowing_bucket"] = lambda: _last_three("operating_loss_pct_revenue", lambda a, b, c: F.when((c < b) & (b < a), "two_years").when(c < b, "one_year").otherwise("widening"))


def _band(name: str, source: str, low: float, high: float | None = None) -> None:
    """A flag for a share above `low` (exclusive), up to `high` (inclusive)."""
    REGISTRY[name] = lambda: (F.col(source) > low) & (F.lit(True) if high is None else F.col(source) <= high)


# Extensions: flags on what an issuer states itself.
REGISTRY["cash_flow_quality_below_50pct"] = lambda: (F.when(F.col("net_income_3yr") > 0, F.col("operating_cash_flow_3yr") / F.col("net_income_3yr") < 0.5), F.col("operating_cash_flow_3yr").isNotNull() & (F.col("net_income_3yr") <= 0))
_band("dso_above_60", "trade_receivables_days", 60)
_band("dso_above_90", "trade_receivables_days", 90)
REGISTRY["dso_above_120_or_spike"] = lambda: F.when(F.col("trade_receivables_days").isNotNull(), (F.col("trade_receivables_days") > 120) | F.coalesce((at("receivable_days", 2) > 0) & (at("receivable_days") / at("receivable_days", 2) > 1.25), F.lit(False)))
for _low in (20, 35, 50):
    _band(f"working_capital_above_{_low}", "net_working_capital_pct_revenue", _low)
_band("promoter_pledge_upto_25", "promoter_pledged_shares_pct", 0, 25)
_band("promoter_pledge_25_to_50", "promoter_pledged_shares_pct", 25, 50)
_band("promoter_pledge_above_50", "promoter_pledged_shares_pct", 50)
REGISTRY["low_pre_issue_promoter_holding"] = lambda: F.when(F.col("pre_issue_promoter_holding_pct").isNotNull(), (F.col("pre_issue_promoter_holding_pct") < 20) & ~F.coalesce("professionally_managed", F.lit(False)))
_band("top_customer_concentration_25_to_50", "top_customer_revenue_pct", 25, 50)
_band("top_customer_concentration_above_50", "top_customer_revenue_pct", 50)
_passed("loss_making_segments_present")
_band("contingent_liabilities_10_to_25", "contingent_liabilities_pct_net_worth", 10, 25)
_band("contingent_liabilities_above_25", "contingent_liabilities_pct_net_worth", 25)
_passed("material_regulatory_disputes_present")

#: What categorical metrics can tell, by which policies map them to points.
DOMAINS = {
    "margin_trend": ("expanding", "stable", "volatile", "declining_or_loss"),
    "margin_trend_5y_avg": ("expanding", "stable", "volatile", "declining_or_loss"),
    "leverage_bucket": ("strong", "ok", "stretched", "weak"),
    "sector_ipo_relative": ("cheaper", "in_line", "richer"),
    "ofs_seller_bucket": ("none_or_small", "pe_vc_exit", "promoter_selling"),
    "use_of_proceeds_bucket": ("growth", "mixed_ok", "debt_heavy", "blind_heavy"),
    "pre_ipo_placement_bucket": ("none_or_near_ipo", "in_between", "deep_discount_12m"),
    "lockin_bucket": ("intact", "weak"),
    "auditor_bucket": ("clean_reputed", "eom_only", "unstable_or_repeated_eom"),
    "board_kmp_bucket": ("independent_stable", "other", "high_churn"),
    "market_regime_variant": ("hot", "normal"),
    "nim_cost_income_bucket": ("improving", "stable", "mixed", "deteriorating"),
    "roa_roe_peer_quartile": ("top_quartile", "median", "bottom_half"),
    "asset_quality_bucket": ("improving_strong", "stable", "deteriorating", "stressed"),
    "net_debt_bucket": ("strong", "ok", "stretched", "weak"),
    "contribution_bucket": ("expanding_2y_gt300bps", "positive_improving", "positive_flat_or_falling", "negative"),
    "loss_narrowing_bucket": ("two_years", "one_year", "widening"),
}


def derive(issues: DataFrame, names: list[str] | None = None, overrides: dict[str, Column] | None = None, layer: int = 12) -> DataFrame:
    """`issues` with the metrics named (all, if none are).

    An override replaces a metric's value after it is derived, so metrics that
    build on it still use what was derived.
    """
    out = complete(issues)
    names = names or list(REGISTRY)
    made: list[dict[str, Column]] = []
    for k in range(0, len(names), layer):
        columns: dict[str, Column] = {}
        for name in names[k : k + layer]:
            value = REGISTRY[name]()
            value, na = value if isinstance(value, tuple) else (value, F.lit(False))
            columns[f"__m_{name}"], columns[f"{name}__na"] = value, F.coalesce(na, F.lit(False))
        made.append(columns)
    out = reduce(lambda df, columns: df.withColumns(columns), made, out)
    return out.withColumns({n: F.coalesce((overrides or {}).get(n, F.lit(None)), F.col(f"__m_{n}")) for n in names}).drop(*[f"__m_{n}" for n in names])


def state(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), "VALUE").when(F.col(f"{name}__na"), "NOT_APPLICABLE").otherwise("UNKNOWN")


def long_form(derived: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, metric_id, state, kind, value): one row for each metric."""
    kinds = dict(derived.dtypes)
    kind = lambda n: "boolean" if kinds[n] == "boolean" else "categorical" if kinds[n] == "string" else "numeric"
    return derived.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric_id"), state(n).alias("state"), F.lit(kind(n)).alias("kind"), F.col(n).cast("string").alias("value")) for n in names])).alias("m")).select(key, "m.*")
