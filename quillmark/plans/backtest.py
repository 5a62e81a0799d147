"""Statistics, quantiles and diagnostics of the backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import stats
from quillmark.plans.base import BACKTEST, EVALUATIONS, OUTCOMES, PREDICTORS, backtest, evaluations
from quillmark.plans.registry import query

UNPIVOT = BACKTEST + f", long AS (UNPIVOT (SELECT evaluation_id, verdict, stamp, {', '.join(OUTCOMES)} FROM backtest) ON {', '.join(OUTCOMES)} INTO NAME outcome VALUE v)"


def outcomes(spark, sf_dir):
    return backtest(spark, sf_dir).unpivot(["evaluation_id", "verdict", "stamp"], OUTCOMES, "outcome", "v")


@query("a1_described", UNPIVOT + """, s AS (
  SELECT outcome, list_sort(list(v)) AS l FROM long GROUP BY 1)
SELECT outcome, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS min, max(v) AS max,
       round(coalesce(stddev_samp(v), 0), 6) AS std, count(*) FILTER (v > 0) AS positive, count(*) FILTER (v < 0) AS negative,
       count(*) FILTER (abs(v) <= 1e-9) AS zero, round(100.0 * count(*) FILTER (v > 0) / count(*), 6) AS positive_rate,
       any_value(l[CAST(floor(0.25 * (len(l) - 1)) AS INT) + 1]) AS q1, any_value(l[CAST(floor(0.75 * (len(l) - 1)) AS INT) + 1]) AS q3
FROM long JOIN s USING (outcome) GROUP BY outcome""")
def a1_described(spark, sf_dir):
    return stats.described(outcomes(spark, sf_dir), ["outcome"], "v")


@query("a2_status_breakdown", BACKTEST + """, s AS (
  SELECT CASE WHEN return_1w IS NOT NULL AND return_1m IS NOT NULL AND return_6m IS NOT NULL THEN 'READY'
              WHEN return_1w IS NULL AND return_1m IS NULL AND return_6m IS NULL THEN 'INCOMPLETE' ELSE 'PARTIAL' END AS status FROM backtest)
SELECT d.status, count(s.status) AS n FROM (VALUES ('READY'), ('PARTIAL'), ('INCOMPLETE'), ('UNVERIFIED'), ('INVALID')) d(status) LEFT JOIN s USING (status) GROUP BY 1""")
def a2_status_breakdown(spark, sf_dir):
    have = sum((F.col(f"return_{h}").isNotNull().cast("int") for h in ("1w", "1m", "6m")), F.lit(0))
    status = backtest(spark, sf_dir).select(F.when(have == 3, "READY").when(have == 0, "INCOMPLETE").otherwise("PARTIAL").alias("status")).groupBy("status").count()
    domain = spark.createDataFrame([(s,) for s in ("READY", "PARTIAL", "INCOMPLETE", "UNVERIFIED", "INVALID")], "status string")
    return domain.join(status, "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


HIT = "count(v) AS n, count(*) FILTER (v > 0) AS hits, count(v) - count(*) FILTER (v > 0) AS misses, round(100.0 * count(*) FILTER (v > 0) / nullif(count(v), 0), 6) AS hit_rate, CASE WHEN count(v) = 0 THEN 'NO_DATA' ELSE 'CALCULATED' END AS status"


@query("a3_hit_rates", UNPIVOT + f" SELECT outcome, {HIT} FROM long GROUP BY 1")
def a3_hit_rates(spark, sf_dir):
    return stats.hit_rates(outcomes(spark, sf_dir), ["outcome"], "v")


@query("a4_hit_populations", UNPIVOT + f""" SELECT coalesce(verdict, 'ALL') AS population, outcome, {HIT} FROM long
GROUP BY GROUPING SETS ((outcome), (verdict, outcome)) HAVING NOT (grouping(verdict) = 0 AND outcome IN ('listing_gain', 'excess_1w', 'excess_1m'))""")
def a4_hit_populations(spark, sf_dir):
    long = outcomes(spark, sf_dir)
    everyone = long.select(F.explode(F.array(F.lit("ALL"), "verdict")).alias("population"), "outcome", "v")
    return stats.hit_rates(everyone.where((F.col("population") == "ALL") | ~F.col("outcome").isin("listing_gain", "excess_1w", "excess_1m")), ["population", "outcome"], "v")


@query("a5_vintages", BACKTEST + """
SELECT split_part(stamp, '-', 1) AS vintage, count(*) AS n, round(avg(final_score), 4) AS mean_score, round(avg(return_1w), 6) AS mean_1w, round(avg(excess_6m), 6) AS mean_excess_6m,
       round(100.0 * count(*) FILTER (return_1w > 0) / nullif(count(return_1w), 0), 6) AS positive_rate FROM backtest GROUP BY 1""")
def a5_vintages(spark, sf_dir):
    return backtest(spark, sf_dir).groupBy(stats.vintage(F.col("stamp")).alias("vintage")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("final_score"), 4).alias("mean_score"), F.round(F.avg("return_1w"), 6).alias("mean_1w"), F.round(F.avg("excess_6m"), 6).alias("mean_excess_6m"),
        F.round(F.try_divide(100.0 * F.count_if(F.col("return_1w") > 0), F.count("return_1w")), 6).alias("positive_rate"),
    )


@query("a6_temporal_holdout", BACKTEST + """, y AS (SELECT *, split_part(stamp, '-', 1) AS year FROM backtest), m AS (SELECT max(year) AS last FROM y)
SELECT year = last AS is_holdout, count(*) AS n, round(avg(return_1w), 6) AS mean_1w, round(avg(final_score), 4) AS mean_score FROM y, m GROUP BY 1""")
def a6_temporal_holdout(spark, sf_dir):
    rows = backtest(spark, sf_dir).withColumn("year", stats.vintage(F.col("stamp")))
    return stats.holdout_split(rows, "year").groupBy("is_holdout").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("return_1w"), 6).alias("mean_1w"), F.round(F.avg("final_score"), 4).alias("mean_score"))


@query("a7_benchmark_means", BACKTEST + " ".join(f"{'UNION ALL' if i else ''} SELECT '{h}' AS horizon, count(excess_{h}) AS n, round(avg(benchmark_{h}), 6) AS mean_benchmark, round(avg(excess_{h}), 6) AS mean_excess FROM backtest" for i, h in enumerate(("1w", "1m", "6m"))))
def a7_benchmark_means(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"benchmark_{h}").alias("b"), F.col(f"excess_{h}").alias("e")) for h in ("1w", "1m", "6m")]))
    return backtest(spark, sf_dir).select(each.alias("x")).groupBy("x.horizon").agg(F.count("x.e").alias("n"), F.round(F.avg("x.b"), 6).alias("mean_benchmark"), F.round(F.avg("x.e"), 6).alias("mean_excess"))


RANKED = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0"
RHO = "count(*) AS n, CASE WHEN count(*) < 3 THEN NULL WHEN var_pop(rx) = 0 OR var_pop(ry) = 0 THEN 0.0 ELSE round(corr(rx, ry), 6) END AS value, CASE WHEN count(*) < 3 THEN 'INSUFFICIENT_DATA' WHEN var_pop(rx) = 0 OR var_pop(ry) = 0 THEN 'UNDEFINED_ZERO_VARIANCE' ELSE 'CALCULATED' END AS status"


@query("a8_rank_correlation", BACKTEST + f""", r AS (
  SELECT verdict, {RANKED.format(k='verdict', c='final_score')} AS rx, {RANKED.format(k='verdict', c='return_1w')} AS ry FROM backtest WHERE return_1w IS NOT NULL)
SELECT verdict, {RHO} FROM r GROUP BY 1""")
def a8_rank_correlation(spark, sf_dir):
    return stats.rank_correlation(backtest(spark, sf_dir), ["verdict"], "final_score", "return_1w")


PAIRS = BACKTEST + f""", p AS (UNPIVOT (SELECT evaluation_id, {', '.join(PREDICTORS + OUTCOMES)} FROM backtest) ON {', '.join(PREDICTORS)} INTO NAME predictor VALUE x),
q AS (UNPIVOT p ON {', '.join(OUTCOMES)} INTO NAME outcome VALUE y),
r AS (SELECT predictor, outcome, {RANKED.format(k='predictor, outcome', c='x')} AS rx, {RANKED.format(k='predictor, outcome', c='y')} AS ry FROM q)
SELECT predictor, outcome, {RHO} FROM r GROUP BY 1, 2"""


@query("a9_correlation_matrix", PAIRS)
def a9_correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(backtest(spark, sf_dir), "evaluation_id", PREDICTORS, OUTCOMES)


MODULES = [f"module_{m}" for m in "abcdef"]


@query("a10_module_diagnostics", BACKTEST + f""", p AS (UNPIVOT (SELECT evaluation_id, {', '.join(MODULES)}, return_1w, return_1m, return_6m FROM backtest) ON {', '.join(MODULES)} INTO NAME module VALUE x),
q AS (UNPIVOT p ON return_1w, return_1m, return_6m INTO NAME horizon VALUE y),
r AS (SELECT module, horizon, y, {RANKED.format(k='module, horizon', c='x')} AS rx, {RANKED.format(k='module, horizon', c='y')} AS ry FROM q)
SELECT module, horizon, {RHO}, round(100.0 * count(*) FILTER (y > 0) / count(*), 6) AS positive_rate FROM r GROUP BY 1, 2""")
def a10_module_diagnostics(spark, sf_dir):
    """Six modules by three horizons."""
    returns_ = ["return_1w", "return_1m", "return_6m"]
    long = backtest(spark, sf_dir).unpivot(["evaluation_id", *returns_], MODULES, "module", "x").unpivot(["evaluation_id", "module", "x"], returns_, "horizon", "y").where("x is not null and y is not null")
    rate = long.groupBy("module", "horizon").agg(F.round(100.0 * F.count_if(F.col("y") > 0) / F.count(F.lit(1)), 6).alias("positive_rate"))
    return stats.rank_correlation(long, ["module", "horizon"], "x", "y").join(rate, ["module", "horizon"])


@query("a12_peer_medians", """SELECT s_nationkey, round(median(s_acctbal) FILTER (s_acctbal > 0), 6) AS median, CASE WHEN count(*) FILTER (s_acctbal > 0) >= 2 THEN min(s_acctbal) FILTER (s_acctbal > 0) END AS low,
CASE WHEN count(*) FILTER (s_acctbal > 0) >= 2 THEN max(s_acctbal) FILTER (s_acctbal > 0) END AS high FROM supplier GROUP BY 1""")
def a12_peer_medians(spark, sf_dir):
    """Peers' median, and their range where there are two or more; missing multiples are left out."""
    from quillmark.sources.tables import table

    v = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
    two = F.count(v) >= 2
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.median(v), 6).alias("median"), F.when(two, F.min(v)).alias("low"), F.when(two, F.max(v)).alias("high"))


@query("a20_ipo_summary", f"""WITH {EVALUATIONS.strip()} SELECT ipo_id, count(*) AS evaluations, count(*) FILTER (mode = 'FINAL') AS final, count(*) FILTER (mode = 'ARCHIVED') AS archived, max(stamp) AS last_stamp FROM evaluations GROUP BY 1""")
def a20_ipo_summary(spark, sf_dir):
    return evaluations(spark, sf_dir).groupBy("ipo_id").agg(F.count(F.lit(1)).alias("evaluations"), F.count_if(F.col("mode") == "FINAL").alias("final"), F.count_if(F.col("mode") == "ARCHIVED").alias("archived"), F.max("stamp").alias("last_stamp"))


@query("a24_distinct_sets", f"""WITH {EVALUATIONS.strip()} SELECT 'verdict' AS kind, verdict AS value, count(*) AS n FROM evaluations GROUP BY 2 UNION ALL SELECT 'vintage', split_part(stamp, '-', 1), count(*) FROM evaluations GROUP BY 2""")
def a24_distinct_sets(spark, sf_dir):
    kinds = F.explode(F.array(F.struct(F.lit("verdict").alias("kind"), F.col("verdict").alias("value")), F.struct(F.lit("vintage").alias("kind"), stats.vintage(F.col("stamp")).alias("value"))))
    return evaluations(spark, sf_dir).select(kinds.alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


QUANT = ", bucketed AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY verdict) >= {n} THEN CAST((row_number() OVER (PARTITION BY verdict ORDER BY final_score, evaluated_at, ipo_id, evaluation_id) * {n} - 1) // count(*) OVER (PARTITION BY verdict) + 1 AS INT) END AS bucket FROM backtest)"


@query("w3_floor_quintiles", BACKTEST + QUANT.format(n=5) + """ SELECT verdict, bucket, count(*) AS n, round(min(final_score), 2) AS low, round(max(final_score), 2) AS high, round(avg(return_1w), 6) AS mean_1w,
list_sort(list(return_1w) FILTER (return_1w IS NOT NULL))[count(return_1w) // 2 + 1] AS median_1w, round(100.0 * count(*) FILTER (return_1w > 0) / nullif(count(return_1w), 0), 6) AS hit_rate FROM bucketed GROUP BY 1, 2""")
def w3_floor_quintiles(spark, sf_dir):
    return _quantiles(spark, sf_dir, 5)


@query("w3_floor_deciles", BACKTEST + QUANT.format(n=10) + """ SELECT verdict, bucket, count(*) AS n, round(min(final_score), 2) AS low, round(max(final_score), 2) AS high, round(avg(return_1w), 6) AS mean_1w,
list_sort(list(return_1w) FILTER (return_1w IS NOT NULL))[count(return_1w) // 2 + 1] AS median_1w, round(100.0 * count(*) FILTER (return_1w > 0) / nullif(count(return_1w), 0), 6) AS hit_rate FROM bucketed GROUP BY 1, 2""")
def w3_floor_deciles(spark, sf_dir):
    return _quantiles(spark, sf_dir, 10)


def _quantiles(spark, sf_dir, n):
    order = [F.col(c) for c in ("final_score", "evaluated_at", "ipo_id", "evaluation_id")]
    rows = stats.floor_quantiles(backtest(spark, sf_dir), ["verdict"], order, n, "final_score")
    told = rows.groupBy("verdict", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("final_score"), 2).alias("low"), F.round(F.max("final_score"), 2).alias("high"), F.round(F.avg("return_1w"), 6).alias("mean_1w"),
        F.round(F.try_divide(100.0 * F.count_if(F.col("return_1w") > 0), F.count("return_1w")), 6).alias("hit_rate"),
    )
    medians = stats.upper_medians(rows, ["verdict", "bucket"], "return_1w", "median_1w").withColumnsRenamed({"verdict": "__v", "bucket": "__b"})
    return told.join(medians, F.col("verdict").eqNullSafe(F.col("__v")) & F.col("bucket").eqNullSafe(F.col("__b")), "left").drop("__v", "__b")


@query("w1_average_rank", BACKTEST + " SELECT evaluation_id, verdict, " + RANKED.format(k="verdict", c="module_a") + " AS rank FROM backtest WHERE module_a IS NOT NULL")
def w1_average_rank(spark, sf_dir):
    return stats.average_ranks(backtest(spark, sf_dir), ["verdict"], "module_a").select("evaluation_id", "verdict", "rank")


@query("m12_maturity", BACKTEST + """ SELECT verdict, split_part(stamp, '-', 1) AS vintage, count(*) AS n, CASE WHEN count(*) < 30 THEN 'DESCRIPTIVE_ONLY' WHEN count(*) < 100 THEN 'EXPLORATORY' ELSE 'STATISTICALLY_ACTIONABLE_FOR_DIAGNOSTICS' END AS maturity FROM backtest GROUP BY 1, 2""")
def m12_maturity(spark, sf_dir):
    n = F.count(F.lit(1))
    return backtest(spark, sf_dir).groupBy("verdict", stats.vintage(F.col("stamp")).alias("vintage")).agg(n.alias("n"), stats.maturity(n).alias("maturity"))


@query("r15_dataset", BACKTEST + """ SELECT evaluation_id, ipo_id, return_1w, return_1m, return_6m, CASE WHEN final_score IS NULL THEN 'INVALID' WHEN return_1w IS NOT NULL AND return_1m IS NOT NULL AND return_6m IS NOT NULL THEN 'READY' WHEN coalesce(return_1w, return_1m, return_6m) IS NOT NULL THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS row_status FROM backtest""")
def r15_dataset(spark, sf_dir):
    from quillmark.operators.dataset import row_status

    rows = backtest(spark, sf_dir)
    return rows.select("evaluation_id", "ipo_id", "return_1w", "return_1m", "return_6m", row_status(F.col("final_score").isNull(), F.lit(False), [F.col(f"return_{h}") for h in ("1w", "1m", "6m")]).alias("row_status"))


@query("r17_leakage_audit", BACKTEST + """, r AS (SELECT *, CASE WHEN evaluation_id % 5 = 0 THEN evaluated_at + INTERVAL 1 DAY ELSE evaluated_at - INTERVAL 1 DAY END AS listed FROM backtest),
f AS (SELECT 'timestamp_ordering' AS name, count(*) AS n FROM r WHERE CAST(evaluated_at AS DATE) > CAST(listed AS DATE) UNION ALL SELECT 'predictor_independence', count(*) FROM r WHERE final_score IS NULL UNION ALL SELECT 'final_linkage_intact', count(*) FROM r WHERE evaluation_id IS NULL OR verdict IS NULL
  UNION ALL SELECT 'row_status_valid', count(*) FROM r WHERE return_1w IS NULL AND return_1m IS NULL AND return_6m IS NULL UNION ALL SELECT 'observation_hashes_valid', count(*) FROM r WHERE return_1w > 2 UNION ALL SELECT 'observation_temporal_validity', 0 UNION ALL SELECT 'no_config_drift', 0 UNION ALL SELECT 'no_future_leakage', 0)
SELECT name AS "check", n = 0 AS passed, n AS findings FROM f""")
def r17_leakage_audit(spark, sf_dir):
    from quillmark.operators.dataset import leakage

    rows = backtest(spark, sf_dir)
    listed = F.when(F.col("evaluation_id") % 5 == 0, F.date_add("evaluated_at", 1)).otherwise(F.date_sub("evaluated_at", 1))
    status = F.when(F.col("return_1w").isNull() & F.col("return_1m").isNull() & F.col("return_6m").isNull(), "INVALID").otherwise("READY")
    digest = F.when(F.col("return_1w") > 2, "short").when(F.col("return_1w").isNotNull(), F.sha2(F.col("evaluation_id").cast("string"), 256))
    given = rows.select("evaluation_id", F.col("verdict").alias("result_hash"), F.date_format("evaluated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("evaluated_at"), F.date_format(listed, "yyyy-MM-dd").alias("listing_date"), "final_score", status.alias("row_status"), digest.alias("hash_1w"), F.lit(None).cast("string").alias("hash_1m"))
    return leakage(given, ["hash_1w", "hash_1m"])


@query("m11_rescored", BACKTEST + """ SELECT evaluation_id, CAST(round(CAST(coalesce(module_a, 0) / 50 * 29.371 + coalesce(module_c, 0) / 0.1 * 19.133 + coalesce(module_d, 0) / 0.08 * 9.717 AS DECIMAL(20, 9)), 2) AS DOUBLE) AS rescored FROM backtest""")
def m11_rescored(spark, sf_dir):
    from quillmark.functions.returns import rescored

    return backtest(spark, sf_dir).select("evaluation_id", rescored([(F.col("module_a"), 50.0, 29.371), (F.col("module_c"), 0.1, 19.133), (F.col("module_d"), 0.08, 9.717)]).alias("rescored"))


@query("a22_shadow_totals", BACKTEST + """, v AS (SELECT *, CASE WHEN module_a >= 30 THEN 'APPLY' WHEN module_a >= 20 THEN 'NEUTRAL' ELSE 'AVOID' END AS base, CASE WHEN module_a + module_c * 10 >= 30 THEN 'APPLY' WHEN module_a + module_c * 10 >= 20 THEN 'NEUTRAL' ELSE 'AVOID' END AS shadow FROM backtest WHERE module_a IS NOT NULL)
SELECT base, shadow, count(*) AS n, round(avg(return_1w), 4) AS mean_1w FROM v GROUP BY 1, 2""")
def a22_shadow_totals(spark, sf_dir):
    from quillmark.functions.rules import verdict

    bands = [{"min": 30, "verdict": "APPLY"}, {"min": 20, "verdict": "NEUTRAL"}]
    rows = backtest(spark, sf_dir).where("module_a is not null")
    shadow = verdict(F.col("module_a") + F.col("module_c") * 10, bands)
    return rows.groupBy(verdict(F.col("module_a"), bands).alias("base"), shadow.alias("shadow")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("return_1w"), 4).alias("mean_1w"))


@query("r20_shadow_report", BACKTEST + """, v AS (SELECT floor(least(100, module_a * 1.5) * 100 + 0.5) / 100 AS before, floor((coalesce(module_a, 0) / 50 * 60 + coalesce(module_c, 0) / 0.1 * 40) * 100 + 0.5) / 100 AS after FROM backtest WHERE module_a IS NOT NULL),
w AS (SELECT before, after, CASE WHEN before >= 75 THEN 3 WHEN before >= 60 THEN 2 WHEN before >= 45 THEN 1 ELSE 0 END AS b, CASE WHEN after >= 75 THEN 3 WHEN after >= 60 THEN 2 WHEN after >= 45 THEN 1 ELSE 0 END AS a FROM v)
SELECT count(*) AS n, count(*) FILTER (a <> b) AS shifts, count(*) FILTER (a <> b AND after > before) AS upgrades, count(*) FILTER (a <> b AND after <= before) AS downgrades, count(*) FILTER (a = b) AS unchanged, count(*) FILTER (round(after - before, 2) > 0) AS increased, count(*) FILTER (round(after - before, 2) < 0) AS decreased, round(avg(round(after - before, 2)), 4) AS mean_delta FROM w""")
def r20_shadow_report(spark, sf_dir):
    from quillmark.operators.calibrate import shadow_report
    from quillmark.plans.base import places

    rows = backtest(spark, sf_dir).where("module_a is not null")
    after = places(F.coalesce("module_a", F.lit(0.0)) / 50 * 60 + F.coalesce("module_c", F.lit(0.0)) / 0.1 * 40, 2)
    return shadow_report(rows.select(places(F.least(F.lit(100.0), F.col("module_a") * 1.5), 2).alias("before"), after.alias("after")), "before", "after", [{"min": 75, "verdict": "APPLY"}, {"min": 60, "verdict": "APPLY_SELECTIVELY"}, {"min": 45, "verdict": "NEUTRAL"}])
