"""Assembly and checks of the backtest dataset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text

#: Fixed values.
HORIZONS = ("1W", "1M", "6M")


def row_status(invalid: Column, unverified: Column, returns: Sequence[Column]) -> Column:
    """INVALID, UNVERIFIED, READY (all horizons there), PARTIAL, INCOMPLETE, in this order of weight."""
    have = sum((r.isNotNull().cast("int") for r in returns), F.lit(0))
    return F.when(invalid, "INVALID").when(unverified, "UNVERIFIED").when(have == len(returns), "READY").when(have > 0, "PARTIAL").otherwise("INCOMPLETE")


def eligible(invalid: Column, value: Column, status: Column) -> Column:
    return ~invalid & value.isNotNull() & status.isin("VERIFIED", "UNADJUSTED")


def by_horizon(obs: DataFrame, key: str, value: str) -> DataFrame:
    """A column for each horizon; those that aren't there have status INCOMPLETE."""
    wide = obs.groupBy(key).pivot("horizon", list(HORIZONS)).agg(F.first(value, ignorenulls=True))
    return wide.select(key, *[c for h in HORIZONS for c in (F.col(h).alias(f"return_{h.lower()}"), F.when(F.col(h).isNull(), "INCOMPLETE").otherwise("PRESENT").alias(f"status_{h.lower()}"))])


def linkage(children: DataFrame, parents: DataFrame, key: str, digest: str) -> DataFrame:
    """`children` with link: OK, MISMATCH (another digest) or ORPHAN."""
    p = parents.select(F.col(key).alias("__k"), F.col(digest).alias("__d"))
    met = children.join(p, children[key] == p["__k"], "left")
    return met.withColumn("link", F.when(F.col("__k").isNull(), "ORPHAN").when(F.col("__d").eqNullSafe(F.col(digest)), "OK").otherwise("MISMATCH")).drop("__k", "__d")


def audit(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed) of aggregate conditions, in one pass."""
    one = rows.agg(*[c.alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "check", "passed")


def full_difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): ADDED, REMOVED, CHANGED or SAME, by a full outer join."""
    a, b = old.select(F.col(key).alias("ka"), F.col(value).alias("va")), new.select(F.col(key).alias("kb"), F.col(value).alias("vb"))
    met = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    return met.select(F.coalesce("ka", "kb").alias(key), F.when(F.col("ka").isNull(), "ADDED").when(F.col("kb").isNull(), "REMOVED").when(F.col("va").eqNullSafe(F.col("vb")), "SAME").otherwise("CHANGED").alias("change"))


def first_pages(pages: DataFrame, heading: str, page: str) -> DataFrame:
    """(section, first_page, pages) of each section that any page's heading opens."""
    return pages.withColumn("section", text.section(F.col(heading))).where("section is not null").groupBy("section").agg(F.min(page).alias("first_page"), F.count(F.lit(1)).alias("pages"))


def final_only(evaluations: DataFrame, mode: str = "mode") -> DataFrame:
    """The rows whose mode is FINAL, in any case."""
    return evaluations.where(F.upper(mode) == "FINAL")


def listed(evaluations: DataFrame, mode: str | None = None, **equal) -> DataFrame:
    """Rows that equal every given value; the mode in any case, and not asked for if null."""
    out = evaluations if mode is None else evaluations.where(F.upper("mode") == mode.upper())
    for column, value in equal.items():
        out = out if value is None else out.where(F.col(column) == value)
    return out


def visible(rows: DataFrame, key: str, archived: DataFrame) -> DataFrame:
    """Rows that aren't archived (archived: one column of keys)."""
    gone = archived.toDF("__archived").distinct()
    return rows.join(gone, rows[key] == gone["__archived"], "left_anti")


def assembled(evaluations: DataFrame, observations: DataFrame, inputs: DataFrame, key: str, value: str = "return_pct", status: str = "observation_status") -> DataFrame:
    """Final evaluations with a return and a status for each horizon and their input snapshot, and the row's status.

    observations: in force, one a horizon. A row without an input snapshot is
    INVALID, one with an unverified observation UNVERIFIED; then what is there
    counts.
    """
    wide = observations.groupBy(key).pivot("horizon", list(HORIZONS)).agg(F.first(value, ignorenulls=True).alias("v"), F.first(status, ignorenulls=True).alias("s"))
    wide = wide.select(F.col(key).alias("__k"), *[c for h in HORIZONS for c in (F.col(f"{h}_v").alias(f"return_{h.lower()}"), F.coalesce(f"{h}_s", F.lit("INCOMPLETE")).alias(f"status_{h.lower()}"))])
    given = inputs.withColumnRenamed(key, "__i").withColumn("has_input", F.lit(True))
    rows = final_only(evaluations)
    rows = rows.join(wide, rows[key] == wide["__k"], "left").join(given, rows[key] == given["__i"], "left").drop("__k", "__i")
    rows = rows.fillna("INCOMPLETE", [f"status_{h.lower()}" for h in HORIZONS]).fillna(False, ["has_input"])
    unverified = F.greatest(*[F.col(f"status_{h.lower()}") == "UNVERIFIED" for h in HORIZONS])
    return rows.withColumn("row_status", row_status(~F.col("has_input"), unverified, [F.col(f"return_{h.lower()}") for h in HORIZONS]))


def resolved(evidence: DataFrame, sources: DataFrame, source: str, source_key: str) -> tuple[DataFrame, DataFrame]:
    """Evidence with its source's columns, and a finding for each entry whose source isn't there."""
    met = evidence.join(sources.withColumn("__there", F.lit(True)), evidence[source] == sources[source_key], "left")
    found = met.where("__there").drop("__there")
    dangling = met.where("__there is null").select(*evidence.columns).withColumn("code", F.lit("DANGLING_SOURCE"))
    return found, dangling


def identity(events: DataFrame, issues: DataFrame, key: str, opened: str, closed: str, ids: Sequence[str]) -> DataFrame:
    """`events` with binding: UNBOUND (no issue), INCOMPLETE (no window told), STALE_OR_DIFFERENT (another window), CONFLICT (another id where both tell one) or BOUND."""
    known = issues.select(F.col(key).alias("__key"), F.col(opened).alias("__opened"), F.col(closed).alias("__closed"), *[F.col(c).alias(f"__{c}") for c in ids])
    met = events.join(known, events[key] == known["__key"], "left")
    differs = F.lit(False)
    for c in ids:
        differs = differs | F.coalesce(F.col(c) != F.col(f"__{c}"), F.lit(False))
    binding = (
        F.when(F.col("__key").isNull(), "UNBOUND").when(F.col(opened).isNull() | F.col(closed).isNull(), "INCOMPLETE")
        .when(~(F.col(opened).eqNullSafe(F.col("__opened")) & F.col(closed).eqNullSafe(F.col("__closed"))), "STALE_OR_DIFFERENT").when(differs, "CONFLICT").otherwise("BOUND")
    )
    return met.withColumn("binding", binding).drop("__key", "__opened", "__closed", *[f"__{c}" for c in ids])


def missing_rows(parts: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(kind, item, reason) of what is missing: for each kind a table, its item and its reason (rows without a reason aren't missing)."""
    rows = [df.select(F.lit(kind).alias("kind"), item.cast("string").alias("item"), reason.alias("reason")).where("reason is not null") for kind, (df, item, reason) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of `old` that `new` lacks."""
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


def by_category(entries: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """(keys, amount, undisclosed): total of what is told, and whether anything isn't."""
    return entries.groupBy(*keys).agg(F.sum(amount).alias("amount"), F.bool_or(F.col(amount).isNull()).alias("undisclosed"))


def sold_by_kind(sellers: DataFrame, key: str, kind: str, sold: str) -> DataFrame:
    """(key, promoter_sold, venture_sold, other_sold): promoters and their group count together."""
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col(sold))), F.lit(0.0))
    promoter, venture = F.col(kind).isin("promoter", "promoter_group"), F.col(kind) == "pe_vc"
    return sellers.groupBy(key).agg(of(promoter).alias("promoter_sold"), of(venture).alias("venture_sold"), of(~promoter & ~venture).alias("other_sold"))


def leakage(rows: DataFrame, digests: Sequence[str]) -> DataFrame:
    """(check, passed, findings) of the point-in-time audit: five checks that are made, and three that are only named.

    rows: evaluation_id, result_hash, evaluated_at and listing_date (ISO text),
    final_score, row_status, and columns of observations' digests.
    """
    day = F.split_part("evaluated_at", F.lit("T"), F.lit(1))
    short = reduce(lambda a, b: a | b, [F.coalesce((F.col(d) != "") & (F.length(d) != 64), F.lit(False)) for d in digests])
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    bad = {
        "timestamp_ordering": F.coalesce(day > F.col("listing_date"), F.lit(False)), "predictor_independence": F.col("final_score").isNull() | F.isnan("final_score"), "final_linkage_intact": empty("evaluation_id") | empty("result_hash"),
        "row_status_valid": F.coalesce(F.col("row_status") == "INVALID", F.lit(False)), "observation_hashes_valid": short, **dict.fromkeys(("observation_temporal_validity", "no_config_drift", "no_future_leakage"), F.lit(False)),
    }
    one = rows.agg(*[F.count_if(test).alias(name) for name, test in bad.items()])
    return one.unpivot([], list(bad), "check", "findings").select("check", (F.col("findings") == 0).alias("passed"), "findings")
