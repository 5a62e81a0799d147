"""Prices, as-of returns, versions, freshness and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import freshness, returns
from quillmark.operators import asof, dataset, observe, versions
from quillmark.plans.base import EVALUATIONS, OBSERVATIONS, PRICES, evaluations, observations, places, prices
from quillmark.plans.registry import query
from quillmark.sources.tables import table

LISTINGS = f"""WITH {PRICES.strip()},
days AS (SELECT DISTINCT day FROM prices),
listings AS (SELECT symbol, min(day) AS listed FROM prices GROUP BY 1),
targets AS (SELECT symbol, listed, h.horizon, listed + h.days AS target FROM listings, (VALUES ('1W', 7), ('1M', 30), ('6M', 180)) h(horizon, days))"""


def targets(spark, sf_dir):
    listed = prices(spark, sf_dir).groupBy("symbol").agg(F.min("day").alias("listed"))
    return listed.select("symbol", "listed", F.explode(F.array(*[F.lit(h) for h in returns.HORIZONS])).alias("horizon")).withColumn("target", returns.target_date(F.col("listed"), F.col("horizon")))


@query("j3_asof_dates", LISTINGS + """ SELECT t.symbol, t.horizon, t.target, max(d.day) AS observed FROM targets t LEFT JOIN days d ON d.day <= t.target AND d.day >= t.target - 29 GROUP BY 1, 2, 3""")
def j3_asof_dates(spark, sf_dir):
    days = prices(spark, sf_dir).select("day")
    return asof.resolve_dates(targets(spark, sf_dir), days, "target", "day", "observed").select("symbol", "horizon", "target", "observed")


@query("j3_asof_by_symbol", LISTINGS + """, t AS (SELECT * FROM targets)
SELECT t.symbol, t.horizon, t.target, p.close FROM t ASOF LEFT JOIN prices p ON t.symbol = p.symbol AND t.target >= p.day""")
def j3_asof_by_symbol(spark, sf_dir):
    found = asof.asof_by_key(targets(spark, sf_dir), prices(spark, sf_dir), "symbol", "target", "day", "close", "close")
    return found.select("symbol", "horizon", "target", "close")


@query("j4_weekday_fallback", LISTINGS + """ SELECT symbol, horizon, CASE dayofweek(target) WHEN 0 THEN target - 2 WHEN 6 THEN target - 1 ELSE target END AS observed FROM targets""")
def j4_weekday_fallback(spark, sf_dir):
    return targets(spark, sf_dir).select("symbol", "horizon", returns.last_weekday(F.col("target")).alias("observed"))


R14 = LISTINGS + """, opens AS (SELECT l_partkey AS symbol, CAST(l_shipdate AS DATE) AS day, max(floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000) AS open FROM lineitem GROUP BY 1, 2),
quotes AS (SELECT p.symbol, p.day, CASE WHEN p.symbol % 9 <> 4 THEN o.open END AS open, p.close, CASE WHEN p.symbol % 11 = 0 THEN 0.5 ELSE 1.0 END AS factor FROM prices p JOIN opens o USING (symbol, day)),
plain AS (SELECT day, (sum(CAST(round(close * 10000) AS BIGINT)) // count(*)) / 10000.0 AS level FROM prices GROUP BY 1),
levels AS (SELECT 'NIFTY_50' AS symbol, day, level FROM plain UNION ALL SELECT 'NIFTY_50_TRI', day, level + 7 FROM plain WHERE dayofmonth(day) <= 15),
d AS (SELECT t.symbol, t.horizon, t.listed, t.target, max(d.day) AS observed FROM targets t LEFT JOIN days d ON d.day <= t.target AND d.day >= t.target - 29 GROUP BY ALL),
e AS (SELECT d.*, p_retailprice AS issue_price, CASE WHEN symbol % 13 = 0 THEN 2.0 ELSE 1.0 END AS given, symbol % 17 = 0 AS unverified FROM d JOIN part ON p_partkey = symbol),
o AS (SELECT e.*, f.open AS listing_open, l.close AS raw_close, CASE WHEN coalesce(l.factor, 1) <> 1 AND given = 1 THEN l.factor ELSE given END AS factor, CASE WHEN t.level IS NULL AND n.level IS NOT NULL THEN 'NIFTY_50' ELSE 'NIFTY_50_TRI' END AS benchmark, coalesce(t.level, n.level) AS listing_level
  FROM e LEFT JOIN quotes f ON f.symbol = e.symbol AND f.day = e.listed LEFT JOIN quotes l ON l.symbol = e.symbol AND l.day = e.observed
  LEFT JOIN levels t ON t.symbol = 'NIFTY_50_TRI' AND t.day = e.listed LEFT JOIN levels n ON n.symbol = 'NIFTY_50' AND n.day = e.listed),
a AS (SELECT o.*, z.level AS observed_level, round(raw_close * factor, 6) AS adjusted_close FROM o LEFT JOIN levels z ON z.symbol = o.benchmark AND z.day = o.observed),
r AS (SELECT symbol, horizon, target, observed, benchmark, round((listing_open - issue_price) / issue_price * 100, 6) AS listing_gain, round((adjusted_close - issue_price) / issue_price * 100, 6) AS absolute_return,
  CASE WHEN listing_open > 0 THEN round((adjusted_close - listing_open) / listing_open * 100, 6) END AS secondary_return, CASE WHEN listing_level > 0 THEN round((observed_level - listing_level) / listing_level * 100, 6) END AS benchmark_return,
  CASE WHEN unverified THEN 'UNVERIFIED' WHEN factor <> 1 THEN 'VERIFIED' ELSE 'UNADJUSTED' END AS verification_status, CASE WHEN raw_close IS NULL THEN 'INCOMPLETE' WHEN unverified THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS observation_status FROM a)
SELECT *, round(absolute_return - benchmark_return, 6) AS excess_return FROM r"""


@query("r14_observations", R14)
def r14_observations(spark, sf_dir):
    """Returns from the issue price to each horizon's observed day, beside a total-return benchmark with gaps and its fallback."""
    p = prices(spark, sf_dir)
    opens = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(F.max(places(F.col("l_extendedprice") / F.col("l_quantity"), 4)).alias("open"))
    quotes = p.join(opens, ["symbol", "day"]).select("symbol", "day", F.when(F.col("symbol") % 9 != 4, F.col("open")).alias("open"), "close", F.when(F.col("symbol") % 11 == 0, 0.5).otherwise(1.0).alias("factor"))
    plain = p.groupBy("day").agg((F.floor(F.sum(F.round(F.col("close") * 10000).cast("long")) / F.count(F.lit(1))) / 10000.0).alias("level"))
    levels = plain.select(F.lit("NIFTY_50").alias("symbol"), "day", "level").unionByName(plain.where(F.dayofmonth("day") <= 15).select(F.lit("NIFTY_50_TRI").alias("symbol"), "day", (F.col("level") + 7).alias("level")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("issue_price"))
    listings = targets(spark, sf_dir).drop("target").join(part, "symbol").select("symbol", "horizon", "listed", "issue_price", F.when(F.col("symbol") % 13 == 0, 2.0).otherwise(1.0).alias("factor"), (F.col("symbol") % 17 == 0).alias("unverified"), F.lit("NIFTY_50_TRI").alias("benchmark"))
    made = observe.build(listings, quotes, levels)
    return made.select("symbol", "horizon", "target", "observed", "benchmark", "listing_gain", "absolute_return", "secondary_return", "benchmark_return", "excess_return", "verification_status", "observation_status")


@query("w10_price_conflicts", """SELECT l_partkey AS symbol, CAST(l_shipdate AS DATE) AS day, round(max(floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000) - min(floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000), 4) AS spread, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING max(floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000) - min(floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000) > 1e-6""")
def w10_price_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.to_date("l_shipdate").alias("day"), places(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("close"))
    return asof.price_conflicts(rows).withColumn("spread", F.round("spread", 4))


@query("m2_listing_gain", f"""WITH {PRICES.strip()}, f AS (SELECT symbol, min(day) AS day FROM prices GROUP BY 1) SELECT p.symbol, round((p.close - t.p_retailprice) / t.p_retailprice * 100, 6) AS listing_gain, round(p.close * 1.05, 6) AS adjusted_close FROM f JOIN prices p USING (symbol, day) JOIN part t ON t.p_partkey = p.symbol""")
def m2_listing_gain(spark, sf_dir):
    first = prices(spark, sf_dir).groupBy("symbol").agg(F.min_by("close", "day").alias("close"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), "p_retailprice")
    return first.join(part, "symbol").select("symbol", returns.listing_gain(F.col("close"), F.col("p_retailprice")).alias("listing_gain"), returns.adjusted_close(F.col("close"), F.lit(1.05)).alias("adjusted_close"))


OBS = f"WITH {OBSERVATIONS.strip()}"


@query("j7_in_force", OBS + " SELECT observation_id, horizon, version FROM observations o WHERE NOT EXISTS (SELECT 1 FROM observations s WHERE s.supersedes = o.observation_id)")
def j7_in_force(spark, sf_dir):
    return versions.in_force(observations(spark, sf_dir), "observation_id", "supersedes").select("observation_id", "horizon", "version")


@query("w2_effective_versions", OBS + " SELECT evaluation_id, horizon, max(version) AS version, arg_max(return_pct, version) AS return_pct, false AS is_ambiguous FROM observations GROUP BY 1, 2")
def w2_effective_versions(spark, sf_dir):
    return versions.effective(observations(spark, sf_dir), ["evaluation_id", "horizon"], "version").select("evaluation_id", "horizon", "version", "return_pct", "is_ambiguous")


@query("s8_version_lookup", OBS + " SELECT evaluation_id, observation_id, return_pct FROM observations WHERE horizon = '1M' AND version = 1")
def s8_version_lookup(spark, sf_dir):
    return observations(spark, sf_dir).where("horizon = '1M' and version = 1").select("evaluation_id", "observation_id", "return_pct")


@query("p21_horizon_pivot", OBS + """, e AS (SELECT evaluation_id, horizon, arg_max(return_pct, version) AS r FROM observations GROUP BY 1, 2),
w AS (SELECT evaluation_id, max(r) FILTER (horizon = '1W') AS return_1w, max(r) FILTER (horizon = '1M') AS return_1m, max(r) FILTER (horizon = '6M') AS return_6m FROM e GROUP BY 1)
SELECT *, CASE WHEN return_1w IS NULL THEN 'INCOMPLETE' ELSE 'PRESENT' END AS status_1w, CASE WHEN return_1m IS NULL THEN 'INCOMPLETE' ELSE 'PRESENT' END AS status_1m, CASE WHEN return_6m IS NULL THEN 'INCOMPLETE' ELSE 'PRESENT' END AS status_6m FROM w""")
def p21_horizon_pivot(spark, sf_dir):
    now = versions.effective(observations(spark, sf_dir), ["evaluation_id", "horizon"], "version")
    return dataset.by_horizon(now, "evaluation_id", "return_pct")


@query("j6_linkage", OBS + """, p AS (SELECT o_orderkey AS evaluation_id, o_orderkey % 7 AS digest FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT observation_id, evaluation_id, CASE WHEN version = 2 THEN -1 ELSE evaluation_id % 7 END AS digest FROM observations)
SELECT CASE WHEN p.evaluation_id IS NULL THEN 'ORPHAN' WHEN p.digest = c.digest THEN 'OK' ELSE 'MISMATCH' END AS link, count(*) AS n FROM c LEFT JOIN p USING (evaluation_id) GROUP BY 1""")
def j6_linkage(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("evaluation_id"), (F.col("o_orderkey") % 7).alias("digest"))
    children = observations(spark, sf_dir).select("observation_id", "evaluation_id", F.when(F.col("version") == 2, -1).otherwise(F.col("evaluation_id") % 7).alias("digest"))
    return dataset.linkage(children, parents, "evaluation_id", "digest").groupBy("link").agg(F.count(F.lit(1)).alias("n"))


@query("j11_config_diff", """WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size > 10), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_size < 45)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' WHEN a.v = b.v THEN 'SAME' ELSE 'CHANGED' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def j11_config_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    changed = part.where("v < 45").select("k", F.when(F.col("k") % 10 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return dataset.full_difference(part.where("v > 10"), changed, "k", "v")


@query("a21_latest_per_ipo", f"WITH {EVALUATIONS.strip()} SELECT ipo_id, evaluation_id, stamp, verdict FROM evaluations QUALIFY row_number() OVER (PARTITION BY ipo_id ORDER BY evaluated_at DESC, evaluation_id DESC) = 1")
def a21_latest_per_ipo(spark, sf_dir):
    return versions.latest(evaluations(spark, sf_dir), ["ipo_id"], [F.desc("evaluated_at"), F.desc("evaluation_id")]).select("ipo_id", "evaluation_id", "stamp", "verdict")


@query("w8_active_choice", f"WITH {EVALUATIONS.strip()} SELECT ipo_id, evaluation_id, mode FROM evaluations QUALIFY row_number() OVER (PARTITION BY ipo_id ORDER BY CASE mode WHEN 'FINAL' THEN 0 ELSE 1 END, evaluated_at DESC, evaluation_id DESC) = 1")
def w8_active_choice(spark, sf_dir):
    return versions.latest(evaluations(spark, sf_dir), ["ipo_id"], [F.when(F.col("mode") == "FINAL", 0).otherwise(1), F.desc("evaluated_at"), F.desc("evaluation_id")]).select("ipo_id", "evaluation_id", "mode")


@query("w9_pagination", f"WITH {EVALUATIONS.strip()} SELECT evaluation_id, stamp FROM evaluations ORDER BY evaluated_at DESC, evaluation_id DESC LIMIT 50 OFFSET 50")
def w9_pagination(spark, sf_dir):
    return versions.page(evaluations(spark, sf_dir).select("evaluation_id", "evaluated_at", "stamp"), [F.desc("evaluated_at"), F.desc("evaluation_id")], 2, 50).select("evaluation_id", "stamp")


@query("o4_out_of_order", "SELECT o_custkey, o_orderkey FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p > o_orderdate")
def o4_out_of_order(spark, sf_dir):
    return versions.out_of_order(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderdate"], "o_custkey").select("o_custkey", "o_orderkey")


@query("r22_lifecycle", f"WITH {EVALUATIONS.strip()} SELECT evaluation_id, CASE WHEN row_number() OVER (PARTITION BY ipo_id, mode ORDER BY verdict = '1-URGENT' DESC, evaluated_at DESC, evaluation_id DESC) = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS state FROM evaluations")
def r22_lifecycle(spark, sf_dir):
    events = evaluations(spark, sf_dir).withColumn("ratified", F.col("verdict") == "1-URGENT")
    return versions.lifecycle(events, ["ipo_id", "mode"], [F.desc("evaluated_at"), F.desc("evaluation_id")]).select("evaluation_id", "state")


@query("r22_circles", """WITH RECURSIVE e AS (SELECT p_partkey AS c, CASE WHEN p_partkey % 40 = 0 AND p_partkey % 3 <> 0 THEN p_partkey + 39 ELSE p_partkey - 1 END AS p FROM part),
walk AS (SELECT c AS start, p AS spot FROM e UNION SELECT w.start, e.p FROM walk w JOIN e ON w.spot = e.c) SELECT DISTINCT start AS id FROM walk WHERE spot = start""")
def r22_circles(spark, sf_dir):
    """Circles of forty parts, and long lines that lead nowhere or into one."""
    k = F.col("p_partkey")
    edges = table(spark, sf_dir, "part").select(k.alias("c"), F.when((k % 40 == 0) & (k % 3 != 0), k + 39).otherwise(k - 1).alias("p"))
    return versions.in_circle(edges, "c", "p")


MOMENT = "TIMESTAMP '2024-01-20 00:00:00'"


@query("d5_freshness", f"""SELECT event_type, event_id, floor((epoch_us({MOMENT}) - epoch_us(ts)) / 3.6e9 * 1000 + 0.5) / 1000 AS age_hours, CASE WHEN value < 1 THEN 'MISSING' WHEN epoch_us({MOMENT}) - epoch_us(ts) < -3600000000 THEN 'FUTURE' WHEN epoch_us({MOMENT}) - epoch_us(ts) > 72 * 3600000000::BIGINT THEN 'STALE' ELSE 'FRESH' END AS status FROM events""")
def d5_freshness(spark, sf_dir):
    as_of, now = F.when(F.col("value") >= 1, F.col("ts").cast("timestamp")), F.lit("2024-01-20 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_type", "event_id", places(returns.age_hours(now, F.col("ts").cast("timestamp")), 3).alias("age_hours"), freshness.freshness(as_of, now, freshness.POLICIES["anchor"]).alias("status"))


@query("r7_market_status", f"""SELECT event_type, CASE WHEN value < 1 THEN 'MISSING' WHEN epoch_us({MOMENT}) - epoch_us(ts) > 24 * 3600000000::BIGINT OR epoch_us({MOMENT}) - epoch_us(ts) < -3600000000 THEN 'STALE' ELSE 'FRESH' END AS status, count(*) AS n FROM events GROUP BY 1, 2""")
def r7_market_status(spark, sf_dir):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    status = freshness.market_status(F.col("value") >= 1, F.col("ts").cast("timestamp"), now)
    return table(spark, sf_dir, "events").groupBy("event_type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("r6_peer_status", """SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 'MISSING' WHEN s_nationkey % 4 = 0 THEN 'UNUSABLE' WHEN s_suppkey % 6 < 1 THEN 'UNUSABLE' WHEN s_suppkey % 9 = 0 THEN 'STALE' WHEN s_suppkey % 45 > 30 THEN 'STALE' ELSE 'VALID' END AS status FROM supplier""")
def r6_peer_status(spark, sf_dir):
    now, k = F.lit("2024-03-01 00:00:00").cast("timestamp"), F.col("s_suppkey")
    as_of = F.when(k % 9 != 0, F.timestamp_micros(F.unix_micros(now) - (k % 45) * F.lit(86_400_000_000)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", freshness.peer_status(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")), F.col("s_nationkey") % 4 != 0, (k % 6).cast("double"), as_of, now).alias("status"))


@query("r9_reconciled", """SELECT user_id, event_type, value, max(value) OVER w - min(value) OVER w > 0.001 AS is_conflict FROM events WINDOW w AS (PARTITION BY user_id, event_type) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1""")
def r9_reconciled(spark, sf_dir):
    return freshness.reconciled(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.col("event_id")], "value").select("user_id", "event_type", "value", "is_conflict")


@query("j14_feed_conflicts", "SELECT user_id, CAST(ts AS DATE) AS day, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1, 2 HAVING max(value) - min(value) > 0.001")
def j14_feed_conflicts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.max("value") - F.min("value")).alias("spread")).where("spread > 0.001").withColumn("spread", F.round("spread", 6))


@query("r10_first_known", """WITH m AS (SELECT user_id, max(value) FILTER (event_type = 'purchase') AS a, max(value) FILTER (event_type = 'click') AS b, max(value) AS c FROM events GROUP BY 1) SELECT user_id, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'notice' WHEN b IS NOT NULL THEN 'supplemental' WHEN c IS NOT NULL THEN 'prospectus' END AS source FROM m""")
def r10_first_known(spark, sf_dir):
    of = lambda t: F.max(F.when(F.col("event_type") == t, F.col("value")))
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(of("purchase").alias("a"), of("click").alias("b"), F.max("value").alias("c"))
    value, source = freshness.first_known(("notice", F.col("a")), ("supplemental", F.col("b")), ("prospectus", F.col("c")))
    return m.select("user_id", value.alias("value"), source.alias("source"))


@query("a23_trailing_exits", """SELECT c.o_custkey AS ipo_id, count(*) FILTER (o.o_orderdate BETWEEN c.anchor - INTERVAL 24 MONTH AND c.anchor) AS exits FROM (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS anchor FROM orders GROUP BY 1) c JOIN orders o USING (o_custkey) GROUP BY 1""")
def a23_trailing_exits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ipo_id"), F.to_date("o_orderdate").alias("day"))
    anchor = o.groupBy("ipo_id").agg(F.max("day").alias("anchor"))
    return o.join(anchor, "ipo_id").groupBy("ipo_id").agg(F.count_if(F.col("day").between(returns.months_before(F.col("anchor"), 24), F.col("anchor"))).alias("exits"))


@query("j13_tolerance", """SELECT o_orderkey, round(abs(s - o_totalprice) / abs(o_totalprice) * 100, 4) AS gap_pct FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice <> 0 AND abs(s - o_totalprice) / abs(o_totalprice) * 100 > 50""")
def j13_tolerance(spark, sf_dir):
    from quillmark.operators.validate import disagreeing

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("other"))
    return disagreeing(table(spark, sf_dir, "orders").join(lines, "o_orderkey"), "o_totalprice", "other", 50.0).select("o_orderkey", F.round("gap_pct", 4).alias("gap_pct"))


@query("p19_prelim_final_delta", f"""WITH {EVALUATIONS.strip()}, l AS (SELECT * FROM evaluations QUALIFY row_number() OVER (PARTITION BY ipo_id, mode ORDER BY evaluated_at DESC, evaluation_id DESC) = 1)
SELECT f.ipo_id, round(f.final_score - p.final_score, 4) AS delta, f.verdict <> p.verdict AS verdict_changed FROM l f JOIN l p ON f.ipo_id = p.ipo_id AND f.mode = 'FINAL' AND p.mode = 'PRELIMINARY'""")
def p19_prelim_final_delta(spark, sf_dir):
    """One aggregate instead of a self-join."""
    last = lambda m, c: F.max_by(F.when(F.col("mode") == m, F.col(c)), F.when(F.col("mode") == m, F.struct("evaluated_at", "evaluation_id")))
    both = evaluations(spark, sf_dir).groupBy("ipo_id").agg(last("FINAL", "final_score").alias("f"), last("PRELIMINARY", "final_score").alias("p"), last("FINAL", "verdict").alias("fv"), last("PRELIMINARY", "verdict").alias("pv"))
    return both.where("f is not null and p is not null").select("ipo_id", F.round(F.col("f") - F.col("p"), 4).alias("delta"), (F.col("fv") != F.col("pv")).alias("verdict_changed"))


@query("p17_top_strengths", """WITH c AS (UNPIVOT (SELECT l_orderkey AS evaluation_id, round(avg(l_quantity) / 50, 6) AS quantity, round(avg(l_discount) / 0.1, 6) AS discount, round(avg(l_tax) / 0.08, 6) AS tax, round(avg(l_linenumber) / 7, 6) AS lines FROM lineitem GROUP BY 1) ON quantity, discount, tax, lines INTO NAME criterion VALUE share)
SELECT evaluation_id, criterion, share, row_number() OVER w AS rank FROM c WINDOW w AS (PARTITION BY evaluation_id ORDER BY share DESC, criterion) QUALIFY rank <= 3""")
def p17_top_strengths(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("evaluation_id")).agg(F.round(F.avg("l_quantity") / 50, 6).alias("quantity"), F.round(F.avg("l_discount") / 0.1, 6).alias("discount"), F.round(F.avg("l_tax") / 0.08, 6).alias("tax"), F.round(F.avg("l_linenumber") / 7, 6).alias("lines"))
    long = li.unpivot("evaluation_id", ["quantity", "discount", "tax", "lines"], "criterion", "share")
    return versions.top_k(long, ["evaluation_id"], [F.desc("share"), F.col("criterion")], 3)
