"""Edges that the tables don't hold: nulls, ties, zero variance, unknown states, bad files."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.functions import freshness, hashing, metrics, returns, rules, stats, text
from quillmark.operators import asof, dataset, validate, versions
from quillmark.sources import documents, prices, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_average_ranks_and_flat_correlations(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 2.0), ("a", 20.0, 3.0), ("a", 30.0, 4.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0), ("b", 1.0, 7.0), ("c", 1.0, 1.0), ("c", None, 2.0)], "k string, x double, y double")
    ranks = [r[0] for r in stats.average_ranks(df.where("k = 'a'"), ["k"], "x").select("rank").orderBy("rank").collect()]
    assert ranks == [1.0, 2.5, 2.5, 4.0]
    got = {r["k"]: (r["n"], r["value"], r["status"]) for r in stats.rank_correlation(df, ["k"], "x", "y").collect()}
    assert got["a"][1] == pytest.approx(0.948683) and got["b"] == (3, 0.0, "UNDEFINED_ZERO_VARIANCE") and got["c"] == (1, None, "INSUFFICIENT_DATA")


@pytest.mark.parametrize(("n", "buckets", "sizes"), [(13, 5, [2, 3, 2, 3, 3]), (10, 10, [1] * 10), (4, 5, [])])
def test_floor_quantiles(spark, n, buckets, sizes):
    df = stats.floor_quantiles(spark.range(n).withColumn("p", F.lit(1)), ["p"], [F.col("id")], buckets, "id")
    assert [r["count"] for r in df.where("bucket is not null").groupBy("bucket").count().orderBy("bucket").collect()] == sizes


def test_ranks_and_quantiles_of_odd_values(spark):
    """Negative, huge, tiny and repeated values, and a population without a key."""
    import random

    rng = random.Random(3)
    values = [rng.choice([-1e9, -2.5, -1e-7, 0.0, 1e-12, 0.1, 3.0, 1e6]) * rng.randint(1, 40) for _ in range(800)]
    df = spark.createDataFrame([(None if i % 3 else "k", float(v), i) for i, v in enumerate(values)], "k string, v double, i int")
    got = {r["i"]: r["rank"] for r in stats.average_ranks(df, ["k"], "v").collect()}
    for own in (range(0, 800, 3), [i for i in range(800) if i % 3]):
        rounded = {i: round(values[i], 12) for i in own}
        for i in own:
            less, same = sum(rounded[j] < rounded[i] for j in own), sum(rounded[j] == rounded[i] for j in own)
            assert got[i] == less + (same + 1) / 2
    buckets = {r["i"]: r["bucket"] for r in stats.floor_quantiles(df.withColumn("p", F.lit(1)), ["p"], [F.col("v"), F.col("i")], 7, "v").collect()}
    order = sorted(range(800), key=lambda i: (values[i], i))
    assert all(buckets[i] == (7 * (n + 1) - 1) // 800 + 1 for n, i in enumerate(order))


def test_order_checks_over_ranges(spark):
    rows = [(i, (i * 7919) % 97) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int")
    want = [b[0] for a, b in zip(rows, rows[1:], strict=False) if a[1] > b[1]]
    assert sorted(r["i"] for r in versions.out_of_order(df, "i", ["v"], width=16).collect()) == want


def test_circles_of_any_length(spark):
    edges = [(i, (i + 1) % 150) for i in range(150)] + [(1000 + i, 999 + i) for i in range(200)] + [(5000, 5000), (6000, 5)]
    got = {r["id"] for r in versions.in_circle(spark.createDataFrame(edges, "c int, p int"), "c", "p").collect()}
    assert got == {*range(150), 5000}
    with pytest.raises(ValueError, match="several parents"):
        versions.in_circle(spark.createDataFrame([(1, 2), (1, 3)], "c int, p int"), "c", "p")


def test_described_of_one_value(spark):
    r = stats.described(spark.createDataFrame([("a", 3.0), ("a", None)], "k string, v double"), ["k"], "v").first()
    assert (r["n"], r["std"], r["q1"], r["q3"]) == (1, 0.0, 3.0, 3.0)


def test_lower_quartiles_are_elements(spark):
    r = stats.described(spark.range(1, 7).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v")), ["k"], "v").first()
    assert (r["q1"], r["q3"]) == (2.0, 4.0)


def test_kleene(spark):
    tree = {"any": [{"flag": "a"}, {"not": {"flag": "b"}}]}
    df = spark.createDataFrame([(True, None), (None, None), (False, True), (None, False)], "a boolean, b boolean")
    assert [r[0] for r in df.select(rules.truth(tree, df.columns)).collect()] == [True, None, False, True]
    assert one(spark, rules.truth({"flag": "missing"}, [])) is None


def test_criterion_states(spark):
    df = spark.createDataFrame([(1, 30.0, "x", False, None), (2, None, None, False, None), (3, None, "z", True, None)], "id int, m double, c string, m__na boolean, f boolean")
    policy = {"modules": [{"id": "A", "criteria": [{"id": "m", "max": 5, "metric": "m", "rule": {"type": "bands", "bands": [[">", 10, 9]]}}, {"id": "c", "max": 2, "metric": "c", "rule": {"type": "categorical", "map": {"x": 1}}}, {"id": "p", "kind": "penalty", "points": -1, "when": {"flag": "f"}}]}], "modes": {"early": {"exclude": ["c"]}}}
    got = {(r["id"], r["criterion"]): (r["state"], r["points"]) for r in rules.criteria(df, "id", policy).collect()}
    assert got[1, "m"] == ("SCORED", 5.0) and got[2, "m"] == ("UNKNOWN", None) and got[3, "m"] == ("NOT_APPLICABLE", None)
    assert got[3, "c"] == ("UNKNOWN", None) and got[1, "p"] == ("UNKNOWN", None)
    assert {r["state"] for r in rules.criteria(df, "id", policy, "early").where("criterion = 'c'").collect()} == {"EXCLUDED_BY_MODE"}


def test_overlay_and_domains():
    base = {"modules": [{"id": "A", "criteria": [{"id": "x", "max": 5}, {"id": "y", "max": 3}]}]}
    out = rules.overlaid(base, [{"remove": ["y"], "override": {"x": {"max": 4}}, "add": {"A": [{"id": "z", "max": 2}]}}])
    assert [(c["id"], c["max"]) for c in out["modules"][0]["criteria"]] == [("x", 4), ("z", 2)] and out["modules"][0]["max"] == 6
    assert base["modules"][0]["criteria"][0]["max"] == 5
    assert rules.domain_gaps(["a", "b"], ["b", "c"]) == (["a"], ["c"])


def test_steps_are_clamped_one_by_one(spark):
    assert one(spark, rules.stepwise(F.lit(5.0), F.array(F.lit(10.0), F.lit(-3.0)), 8)) == 5.0


def issue(**given):
    periods = given.pop("years", [])
    fields = {f: None for f in metrics.PERIOD_FIELDS}
    return {"ipo_id": 1, "periods": [{"fy": str(2020 + i), "is_stub": False, **fields, **p} for i, p in enumerate(periods)], **given}


def derive(spark, names, **given):
    given = issue(**given)
    kinds = {**{c: t for t, cs in metrics.SCALARS.items() for c in cs}, **metrics.ARRAYS}
    df = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'int' if k == 'ipo_id' else kinds[k]}" for k in given))
    r = metrics.derive(df, names).select(*names, *[metrics.state(n).alias(f"s_{n}") for n in names]).first()
    return {n: (r[f"s_{n}"], r[n]) for n in names}


def test_metrics(spark):
    years = [{"revenue": 100.0, "pat": 5.0, "ebitda": 10.0, "cfo": 4.0, "net_worth": 50.0, "total_debt": 20.0}, {"revenue": 120.0, "pat": 8.0, "ebitda": 14.0, "cfo": 6.0, "net_worth": 60.0, "total_debt": 20.0}, {"revenue": 144.0, "pat": 12.0, "ebitda": 19.0, "cfo": 9.0, "net_worth": 75.0, "total_debt": 20.0, "ebit": 16.0, "interest_expense": 2.0, "cash_and_equivalents": 5.0}]
    names = ["revenue_cagr_2y_from_3fy", "revenue_cagr_3y_from_4fy", "margin_trend", "margin_trend_5y_avg", "roce_latest", "cfo_pat_cumulative", "leverage_bucket", "pe_used", "pe_premium_pct", "fresh_share_pct", "ofs_seller_bucket", "use_of_proceeds_bucket", "promoter_post_pct", "market_regime_variant", "lockin_bucket", "peg", "cash_runway_months"]
    got = derive(
        spark, names, years=years, price_band_high=100.0, pre_issue_shares=8e6, fresh_shares=2e6, fresh_issue=20.0, ofs=5.0, sellers=[{"type": "promoter", "pre_issue_shares": 6e6, "shares_sold": 5e5}],
        promoter_pre_pct=75.0, proceeds=[{"category": "growth_capex", "amount": 16.0}], peers=[{f: v for f in ("pe", "ev_ebitda", "pb", "ps", "roe_pct", "roa_pct")} for v in (8.0, 10.0)],
    )
    assert got["revenue_cagr_2y_from_3fy"][1] == pytest.approx(20.0) and got["revenue_cagr_3y_from_4fy"] == ("UNKNOWN", None)
    assert got["margin_trend"] == ("VALUE", "expanding") and got["margin_trend_5y_avg"][0] == "UNKNOWN"
    assert got["roce_latest"][1] == pytest.approx(16 / 95 * 100) and got["cfo_pat_cumulative"][1] == pytest.approx(19 / 25)
    assert got["leverage_bucket"] == ("VALUE", "strong") and got["pe_used"][1] == pytest.approx(100 / 12) and got["pe_premium_pct"][1] == pytest.approx((100 / 12 / 9 - 1) * 100)
    assert got["fresh_share_pct"] == ("VALUE", 80.0) and got["ofs_seller_bucket"] == ("VALUE", "promoter_selling") and got["use_of_proceeds_bucket"] == ("VALUE", "growth")
    assert got["promoter_post_pct"][1] == pytest.approx(55.0) and got["market_regime_variant"] == ("VALUE", "normal") and got["lockin_bucket"] == ("UNKNOWN", None)
    assert got["cash_runway_months"] == ("NOT_APPLICABLE", None)


def test_every_metric_of_an_empty_issue_is_unknown(spark):
    got = derive(spark, list(metrics.REGISTRY))
    assert {n for n, (s, _) in got.items() if s != "UNKNOWN"} == {"market_regime_variant", "pre_ipo_placement_bucket"}


def test_returns(spark):
    assert one(spark, returns.listing_gain(F.lit(None).cast("double"), F.lit(10.0))) is None
    with pytest.raises(Exception, match="issue price"):
        one(spark, returns.listing_gain(F.lit(11.0), F.lit(0.0)))
    assert one(spark, returns.effective_factor(F.lit(0.5), F.lit(1.0))) == 0.5 and one(spark, returns.effective_factor(F.lit(0.5), F.lit(2.0))) == 2.0
    assert str(one(spark, returns.target_date(F.to_date(F.lit("2024-01-31")), F.lit("1M")))) == "2024-03-01"
    assert one(spark, returns.has_offset(F.lit("2024-01-01T00:00:00+05:30"))) and not one(spark, returns.has_offset(F.lit("2024-01-01T00:00:00")))


def test_asof_stays_within_its_reach(spark):
    t = spark.sql("select date'2024-03-31' as t union all select date'2024-06-30' union all select null")
    d = spark.sql("select date'2024-03-02' as d union all select date'2024-03-01' union all select date'2024-05-31'")
    got = {str(r["t"]): str(r["o"]) for r in asof.resolve_dates(t, d, "t", "d", "o").collect()}
    assert got == {"2024-03-31": "2024-03-02", "2024-06-30": "None", "None": "None"}


def test_versions(spark):
    rows = spark.createDataFrame([(1, "a", 1, None), (2, "a", 2, 1), (3, "b", 1, None), (4, "b", 1, None)], "id int, k string, v int, s int")
    assert sorted(r["id"] for r in versions.in_force(rows, "id", "s").collect()) == [2, 3, 4]
    assert {r["k"]: r["is_ambiguous"] for r in versions.effective(rows, ["k"], "v").collect()} == {"a": False, "b": True}
    with pytest.raises(ValueError):
        versions.page(rows, [F.col("id")], 0, 10)


def test_freshness(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    gmp = freshness.POLICIES["gmp"]
    assert one(spark, freshness.freshness(at("2024-01-01 12:00:00"), now, gmp, F.lit(False))) == "MISSING"
    assert one(spark, freshness.freshness(at("2024-01-02 00:00:01"), now, gmp, F.lit(True))) == "FUTURE"
    assert one(spark, freshness.peer_status(F.lit(1.0), F.lit(True), F.lit(5.0), at("2025-01-01 00:00:00"), now)) == "VALID"


@pytest.mark.parametrize(("given", "want"), [("1,23,456.78", 123456.78), ("(1,234.5)", -1234.5), ("₹ 5/-", 5.0), ("Rs. 1,000", 1000.0), ("[●]", None), ("NIL", None), ("12a", None), ("", None), (None, None)])
def test_amounts(spark, given, want):
    assert one(spark, text.amount(F.lit(given).cast("string"))) == want


def test_unknown_units_are_errors(spark):
    assert one(spark, text.unit(F.lit("in thousands"))) == "INR_THOUSANDS" and one(spark, text.unit(F.lit("thousands of trees"))) is None
    assert one(spark, text.unit(F.lit("Amounts are in crores (₹ in lakhs)"))) == "INR_CRORES"
    with pytest.raises(Exception, match="unknown unit"):
        one(spark, text.in_crore(F.lit(1.0), F.lit("INR_THOUSANDS")))


def test_canonical_json():
    assert hashing.canonical_json({"b": 1.0, "a": ["é"]}) == '{"a":["é"],"b":{"__float__":"1.0"}}'
    with pytest.raises(ValueError):
        hashing.canonical_json(float("nan"))


def test_strict_json():
    assert documents.strict_json('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError, match="repeated"):
        documents.strict_json('{"a": 1, "a": 2}')


def test_price_files(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('Trade_Date,Ticker,Close_Price,Volume\n2024-01-01, abc ,"1,000.5",10\n2024-01-01,abc,1000.5,11\n')
    assert [(r["symbol"], str(r["day"]), r["close"], r["volume"], r["factor"]) for r in prices.read(spark, str(good)).collect()] == [("ABC", "2024-01-01", 1000.5, 11.0, 1.0)]
    same = tmp_path / "same.json"
    same.write_text(json.dumps({"prices": [{"date": "2024-01-01", "symbol": "x", "close": 5}]}))
    assert prices.read(spark, str(same)).first()["close"] == 5.0
    for body, why in (("DATE,SYMBOL,CLOSE\n2024-01-01,X,-1\n", "bad price row"), ("DATE,SYMBOL,CLOSE\n2024-01-01,X,1\n2024-01-01,X,2\n", "conflicting"), ("DATE,SYMBOL\n2024-01-01,X\n", "no column")):
        bad = tmp_path / f"{abs(hash(body))}.csv"
        bad.write_text(body)
        with pytest.raises(Exception, match=why):
            prices.read(spark, str(bad)).collect()


def test_connectors(spark):
    df = spark.createDataFrame([(1, '{"qib": "2.5", "total": 3, "gmp": 10, "price": 100, "trend": "UP", "peers": [{"name": "p", "pe": 12}]}')], "id int, payload string")
    r = documents.grey_market(documents.subscriptions(df)).first()
    assert (r["qib_x"], r["overall_x"], r["nii_x"], r["gmp_pct"]) == (2.5, 3.0, None, 10.0)
    assert documents.peers(df, "id").first()["pe"] == 12.0 and one(spark, documents.market_regime(F.lit(" Bullish"))) == "supportive"
    with pytest.raises(Exception, match="negative"):
        documents.subscriptions(spark.createDataFrame([(1, '{"nii": -1}')], "id int, payload string")).collect()


def test_append_only_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "store")
    assert sinks.append_new(rows, path, "id") == 2 and sinks.append_new(rows.withColumn("v", F.lit("z")), path, "id") == 0
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.append_new(rows.unionByName(rows), path, "id")


def test_findings_and_linkage(spark):
    years = [{"revenue": 10.0, "pbt": 5.0, "tax": 1.0, "pat": 4.0, "ebit": 5.0, "depreciation": 1.0, "ebitda": 9.0}, {"revenue": -1.0}]
    given = issue(years=years, pre_issue_shares=10.0, fresh_shares=1.0, post_issue_shares=20.0, promoter_pledge_pct=120.0)
    kinds = {**{c: t for t, cs in metrics.SCALARS.items() for c in cs}, **metrics.ARRAYS}
    df = metrics.complete(spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'int' if k == 'ipo_id' else kinds[k]}" for k in given)))
    assert {r["code"] for r in validate.findings(df, "ipo_id", validate.issue_rules()).collect()} == {"TOO_FEW_PERIODS", "NEGATIVE_REVENUE", "OPERATING_PROFIT", "SHARE_COUNT", "PERCENT_RANGE"}
    status = dataset.row_status(F.lit(False), F.lit(True), [F.lit(1.0)])
    assert one(spark, status) == "UNVERIFIED"


def test_policy_findings():
    """A sound policy has none, and each fault its own code."""
    from quillmark.functions import policy
    from quillmark.plans.screening import POLICY
    from quillmark.plans.sheets import OVERLAYS

    assert policy.findings(POLICY) == [] and policy.findings(OVERLAYS, domains=metrics.DOMAINS, total=9) == []
    band = lambda *bands, **kw: {"id": "c", "max": 3, "metric": "peg", "rule": {"type": "bands", "bands": list(bands), "else": 0}, **kw}
    of = lambda *criteria, **kw: [c for c, _, _ in policy.findings({"modules": [{"id": "A", "criteria": list(criteria)}], **kw})]
    ok = band([">", 1, 3])
    assert policy.findings({"modules": []})[0][0] == "CONFIG_NO_MODULES" and of(ok) == []
    assert of(ok, ok) == ["CONFIG_DUPLICATE_CRITERION"] and of(band()) == ["CONFIG_BANDS_EMPTY"] and of(band([">", 1])) == ["CONFIG_BAND_SHAPE"]
    assert of(band(["~", 1, 3])) == ["CONFIG_OPERATOR_INVALID"] and of(band([">", 1, 9])) == ["CONFIG_SCORE_EXCEEDS_MAX"] and of(band([">", 1, -1])) == ["CONFIG_NEGATIVE_SCORE"] and of(band([">", 1, "x"])) == ["CONFIG_BAND_SCORE"]
    assert of(band([">", 1, 3], metric="made_up")) == ["CONFIG_METRIC_UNIMPLEMENTED"] and of({"id": "c"}) == ["CONFIG_CRITERION_NO_MAX", "CONFIG_CRITERION_NO_METRIC", "CONFIG_CRITERION_NO_RULE"]
    assert of({**ok, "rule": {"type": "guess"}}) == ["CONFIG_RULE_TYPE_INVALID"] and of({"id": "p", "kind": "penalty"}) == ["CONFIG_PENALTY_NO_WHEN"]
    mapped = {"id": "m", "max": 3, "metric": "lockin_bucket", "rule": {"type": "categorical", "map": {"intact": 3, "odd": 1}}}
    assert of(mapped) == ["CONFIG_CATEGORICAL_INCOMPLETE", "CONFIG_CATEGORICAL_EXTRA"] and of({**mapped, "rule": {"type": "categorical", "map": {}}}) == ["CONFIG_CATEGORICAL_EMPTY"]
    assert of({**ok, "rule": {"type": "bands_by_variant", "variants": {"hot": ok["rule"]}}}) == ["CONFIG_VARIANTS_INCOMPLETE"] and of(band([">", 1, 3], exclude_in_modes=["never"])) == ["CONFIG_MODE_EXCLUDE_UNKNOWN"]
    assert of(ok, knockouts=[{"id": "K"}]) == ["CONFIG_KNOCKOUT_NO_WHEN", "CONFIG_KNOCKOUT_NO_REQUIRED"] and of(ok, critical_data={"items": ["nothing"]}) == ["CONFIG_CRITICAL_DATA_UNKNOWN"]
    assert of(ok, verdict={"bands": [{"min": 1}, {"min": 2}]}) == ["CONFIG_VERDICT_NO_ELSE", "CONFIG_VERDICT_BANDS_UNORDERED"] and of(ok, verdict={"else": "x"}) == ["CONFIG_VERDICT_NO_BANDS"]
    trees = {"CONFIG_EXPR_EMPTY": {}, "CONFIG_EXPR_NOT_TYPE": {"not": 3}, "CONFIG_EXPR_UNKNOWN": {"x": 1}, "CONFIG_EXPR_NO_OPERATOR": {"metric": "peg", "value": 1}, "CONFIG_EXPR_NO_VALUE": {"metric": "peg", "op": ">"}, "CONFIG_FLAG_UNIMPLEMENTED": {"flag": "no"}, "CONFIG_OPERATOR_VALUE": {"metric": "peg", "in": 3}}
    for code, tree in trees.items():
        assert [c for c, _, _ in policy.expression(tree, "t", ["peg"])] == [code]
    overlay = {"remove": ["zz"], "override": {"yy": {}}, "add": {"Q": [ok]}}
    assert of(ok, sector_overlays={"S": overlay}) == ["CONFIG_OVERLAY_REMOVE_UNKNOWN", "CONFIG_METRIC_OVERRIDE_UNKNOWN_CRITERION", "CONFIG_OVERLAY_UNKNOWN_MODULE", "CONFIG_OVERLAY_ADD_EXISTING"]


def test_unimplemented_overlays_are_errors(spark):
    df = spark.createDataFrame([(1, 3.0)], "ipo_id int, peg double")
    base = {"modules": [{"id": "A", "max": 3, "criteria": [{"id": "c", "max": 3, "metric": "peg", "rule": {"type": "bands", "bands": [[">", 1, 3]], "else": 0}}]}]}
    with pytest.raises(ValueError, match="OVERLAY_SELECTED_BUT_NOT_IMPLEMENTED"):
        rules.evaluate_planned(df, "ipo_id", base, F.lit("BANK"))
    with pytest.raises(ValueError, match="adds up"):
        rules.evaluate_planned(df, "ipo_id", {**base, "sector_overlays": {"BANK": {"remove": ["c"]}}}, F.lit("BANK"), total=3)


def test_stores_and_exports(spark, tmp_path):
    with pytest.raises(Exception, match="UNRESOLVED|cannot be resolved"):
        path = str(tmp_path / "wrong")
        spark.range(1).write.parquet(path)
        sinks.append_new(spark.createDataFrame([(1,)], "other int"), path, "other")
    assert sinks.proposal_json({"b": 1.5, "a": "é"}, str(tmp_path / "p.json")) == (tmp_path / "p.json").read_text() == '{"a":"\\u00e9","b":1.5}'
    for name, n in (("b", 2), ("a", 1)):
        (tmp_path / "e1" / "observations").mkdir(parents=True, exist_ok=True)
        (tmp_path / "e1" / "observations" / f"{name}.json").write_text(json.dumps({"n": n}))
    assert [r["n"] for r in documents.read_observations(spark, str(tmp_path), "e1", "n int").collect()] == [1, 2]
    got = documents.read_evaluations(spark, str(tmp_path / "*" / "observations" / "a.json"), "n int").first()
    assert (got["n"], got["directory"]) == (1, "observations")
    rows = spark.createDataFrame([("t2", 1, 1), ("t1", 2, 2)], "evaluated_at string, ipo_id int, evaluation_id int")
    sinks.export_json(rows, str(tmp_path / "d"), ["evaluated_at"])
    assert [r["ipo_id"] for r in documents.read_dataset(spark, str(tmp_path / "d"), "evaluated_at string, ipo_id int, evaluation_id int").collect()] == [2, 1]


def test_documents_are_evaluated_and_replayed(spark, tmp_path):
    from quillmark import api

    spec = api.load_config({"modules": [{"id": "A", "criteria": [{"id": "debt", "max": 4, "metric": "leverage_bucket", "rule": {"type": "categorical", "map": {"strong": 4, "ok": 2, "stretched": 1, "weak": 0}}}]}], "verdict": {"bands": [{"min": 2, "verdict": "APPLY"}], "else": "AVOID"}})
    path = tmp_path / "doc.json"
    path.write_text(json.dumps({"financials": {"reporting_unit": "INR_LAKHS", "periods": [{"fy": "2024", "net_worth": 900.0, "total_debt": 600.0}]}}))
    got = api.evaluate_file(spark, str(path), spec, "x").first()
    assert (got["final_score"], got["verdict"], got["unknown_points"]) == (2.0, "APPLY", 0.0)
    docs = spark.createDataFrame([("x", path.read_text()), ("y", "{}")], "ipo_id string, document string")
    stored = spark.createDataFrame([tuple(r) for r in api.evaluate(docs, spec).select("ipo_id", "input_hash", "result_hash").collect()], "ipo_id string, input_hash string, result_hash string")
    assert {tuple(r) for r in api.replay(docs, spec, stored).collect()} == {("x", True, True), ("y", True, True)}
    other = docs.withColumn("document", F.lit("{}"))
    assert {tuple(r) for r in api.replay(other, spec, stored).collect()} == {("x", False, False), ("y", True, True)}
    issue = api.issues(docs).where("ipo_id = 'x'").first()
    assert issue["periods"][0]["net_worth"] == 9.0
    with pytest.raises(ValueError, match="CONFIG_NO_MODULES"):
        api.load_config({})


def test_benchmark_levels_of_price_files(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"prices": [{"date": "2024-01-01", "symbol": "nifty50", "close": 5}, {"date": "2024-01-01", "symbol": "abc", "close": 7}], "benchmark_prices": [{"date": "2024-01-01", "symbol": "^NSEI", "close": 6}, {"date": "2024-01-02", "close": 8}, {"symbol": "x"}]}))
    assert {(r["symbol"], str(r["day"]), r["level"]) for r in prices.read_levels(spark, str(path)).collect()} == {("NIFTY_50", "2024-01-01", 6.0), ("NIFTY_50_TRI", "2024-01-02", 8.0)}
