"""Row builders of the fourteen report sheets: evaluations in, one DataFrame for each sheet out.

An evaluation is a row: ipo_id, company_name, evaluation_id, evaluated_at, mode,
config_version, final_score, verdict, and arrays modules, criteria, knockouts,
penalties, peers, blocks, evidence, and observations by horizon.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.versions import latest, top_k

KEY = ["ipo_id", "evaluation_id"]
#: Fixed values.
NAMES = ["IPO_Master", "Evaluations", "Module_Scores", "Criteria_Detail", "Knockouts", "Penalties", "Missing_Unverified", "Evidence", "Market_Snapshots", "Peer_Snapshots", "Post_Listing", "Backtest", "Config_Versions", "Run_Log"]


def exploded(evaluations: DataFrame, column: str) -> DataFrame:
    """One row for each element of an array of structs, beside the evaluation's key."""
    return evaluations.select(*KEY, F.explode(column).alias("x")).select(*KEY, "x.*")


def master(evaluations: DataFrame) -> DataFrame:
    last = latest(evaluations, ["ipo_id"], [F.desc("evaluated_at"), F.desc("evaluation_id")])
    return last.select("ipo_id", "company_name", "evaluation_id", "mode", "final_score", "verdict")


def missing(evaluations: DataFrame) -> DataFrame:
    """What is unknown or unusable, of five kinds."""

    def of(kind: str, column: str, name: str, test: Column) -> DataFrame:
        return exploded(evaluations, column).where(test).select(*KEY, F.lit(kind).alias("kind"), F.col(name).alias("item"), F.col("state" if column in ("criteria", "penalties") else "status").alias("status"))

    parts = [
        of("criterion", "criteria", "criterion", F.col("state") == "UNKNOWN"), of("knockout", "knockouts", "id", F.col("status") == "UNVERIFIED"), of("peer", "peers", "name", F.col("status") != "VALID"),
        of("market", "blocks", "block", F.col("status") != "FRESH"), of("penalty", "penalties", "id", F.col("state") == "UNKNOWN"),
    ]
    return reduce(DataFrame.unionByName, parts)


def evidence(evaluations: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with its source; what points nowhere stays, with nulls."""
    return exploded(evaluations, "evidence").join(sources, "source_id", "left")


def first_present(horizons: Column, field: str) -> Column:
    """The first horizon's value that is there, in the order 1W, 1M, 6M. A value of 0.0 is there."""
    return F.try_element_at(F.filter(F.transform(horizons, lambda h: h[field]), lambda v: v.isNotNull()), F.lit(1))


def post_listing(evaluations: DataFrame) -> DataFrame:
    return evaluations.select(*KEY, first_present(F.col("observations"), "listing_gain").alias("listing_gain"), first_present(F.col("observations"), "absolute_return").alias("absolute_return"))


def excess_6m(returned: Column, index: Column) -> Column:
    return F.round(returned - index, 6)


def backtest(evaluations: DataFrame) -> DataFrame:
    """Final evaluations with their six months' return, the index's, and the excess, to 6 places."""
    six = F.try_element_at(F.filter("observations", lambda h: h["horizon"] == "6M"), F.lit(1))
    rows = evaluations.where(F.upper("mode") == "FINAL")
    return rows.select(*KEY, "final_score", "verdict", six["absolute_return"].alias("return_6m"), six["benchmark_return"].alias("index_6m"), excess_6m(six["absolute_return"], six["benchmark_return"]).alias("excess_6m"))


def criteria_detail(evaluations: DataFrame) -> DataFrame:
    """One row for each criterion of each module of each evaluation."""
    rows = evaluations.select(*KEY, F.explode("modules").alias("m"))
    return rows.select(*KEY, F.col("m.module").alias("module"), F.explode("m.criteria").alias("c")).select(*KEY, "module", "c.*")


def config_versions(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("config_version").agg(F.min("evaluated_at").alias("first_used"), F.max("evaluated_at").alias("last_used"), F.count(F.lit(1)).alias("evaluations"))


def strengths(criteria: DataFrame, k: int = 3) -> DataFrame:
    """Of scored criteria those with the largest share of their maximum, then score, then by id."""
    scored = criteria.where((F.col("state") == "SCORED") & (F.col("max") > 0))
    return top_k(scored, ["evaluation_id"], [F.desc(F.col("points") / F.col("max")), F.desc("points"), F.col("criterion")], k)


def risks(criteria: DataFrame, k: int = 3) -> DataFrame:
    """Applied penalties, then criteria of no points, then unknown ones, by id."""
    rank = F.when((F.col("kind") == "penalty") & (F.col("points") < 0), 0).when((F.col("kind") != "penalty") & (F.col("state") == "SCORED") & (F.col("points") == 0), 1).when(F.col("state") == "UNKNOWN", 2)
    return top_k(criteria.withColumn("risk", rank).where("risk is not null"), ["evaluation_id"], [F.col("risk"), F.col("criterion")], k)


def compared(base: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two evaluations side by side by module or criterion; what only one has stays."""
    a, b = base.select(*keys, F.col(value).alias("before")), other.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full_outer").withColumn("delta", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))


def workbook(evaluations: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """All sheets, by name."""
    flat = evaluations.select(*[c for c, t in evaluations.dtypes if not t.startswith("array")])
    made = [
        master(evaluations), flat, exploded(evaluations, "modules"), exploded(evaluations, "criteria"), exploded(evaluations, "knockouts"), exploded(evaluations, "penalties"), missing(evaluations), evidence(evaluations, sources),
        exploded(evaluations, "blocks"), exploded(evaluations, "peers"), post_listing(evaluations), backtest(evaluations), config_versions(evaluations), evaluations.select(*KEY, "evaluated_at", "mode"),
    ]
    return dict(zip(NAMES, made, strict=True))
