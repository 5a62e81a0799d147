"""Semantic checks of issue documents, as findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import metrics


def disagreeing(rows: DataFrame, primary: str, other: str, percent: float) -> DataFrame:
    """Rows whose two values differ by more than `percent` of the first, with gap_pct; a first value of 0 is passed over."""
    gap = F.abs(F.col(other) - F.col(primary)) / F.abs(F.col(primary)) * 100
    return rows.where(F.col(primary) != 0).withColumn("gap_pct", gap).where(F.col("gap_pct") > percent)


def findings(rows: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, code, severity) for each rule that a row breaks; rules: code -> (severity, broken?). Unknown isn't broken."""
    each = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, bad) in rules.items()])
    return rows.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select(key, "f.*")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def apart(a: Column, b: Column, percent: float) -> Column:
    """Whether two values differ by more than a tolerance of the second."""
    return F.abs(a - b) > F.abs(b) * (percent / 100.0)


def issue_rules() -> dict[str, tuple[str, Column]]:
    """Checks of an issue (columns as in `quillmark.functions.metrics`). Tolerances are fixed values."""
    p = metrics.full_years()
    some = lambda test: F.exists(p, lambda x: F.coalesce(test(x), F.lit(False)))
    sold = F.exists("sellers", lambda s: F.coalesce(s["shares_sold"] > s["pre_issue_shares"], F.lit(False)))
    share = lambda kinds: F.aggregate(F.filter("proceeds", lambda x: x["category"].isin(kinds)), F.lit(0.0), lambda a, x: a + F.coalesce(x["amount"], F.lit(0.0))) / F.col("fresh_issue") * 100
    percents = [F.col(c) for c in ("promoter_pre_pct", "promoter_post_disclosed", "promoter_pledge_pct", "rpt_pct_revenue")]
    return {
        "DUPLICATE_PERIOD": ("ERROR", F.size(F.array_distinct(F.transform(p, lambda x: x["fy"]))) < F.size(p)),
        "TOO_FEW_PERIODS": ("ERROR", F.size(p) < 3),
        "NEGATIVE_REVENUE": ("ERROR", some(lambda x: x["revenue"] < 0)),
        "PROFIT_BEFORE_TAX": ("WARNING", some(lambda x: apart(x["pbt"] - x["tax"], x["pat"], 1.0))),
        "OPERATING_PROFIT": ("WARNING", some(lambda x: apart(x["ebit"] + x["depreciation"], x["ebitda"], 2.0))),
        "SHARE_COUNT": ("ERROR", apart(F.col("pre_issue_shares") + F.col("fresh_shares"), F.col("post_issue_shares"), 0.5)),
        "EARNINGS_PER_SHARE": ("WARNING", apart(metrics.at("pat") * 1e7 / F.col("post_issue_shares"), F.col("post_issue_eps"), 10.0)),
        "OVERSOLD": ("ERROR", sold),
        "PERCENT_RANGE": ("ERROR", reduce(lambda a, b: a | b, [F.coalesce((c < 0) | (c > 100), F.lit(False)) for c in percents])),
        "GCP_LIMIT": ("ERROR", share(["gcp"]) > 25),
        "UNIDENTIFIED_LIMIT": ("ERROR", share(["acquisition_unidentified"]) > 25),
        "COMBINED_LIMIT": ("ERROR", share(["gcp", "acquisition_unidentified"]) > 35),
    }
