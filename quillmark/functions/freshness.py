"""Freshness of market data and peers, and choice among several sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.returns import age_days, age_hours


@dataclass(frozen=True)
class Policy:
    """Oldest and most future age in hours, and whether the timestamp must name its offset."""

    most_hours: float
    future_hours: float = 1.0
    offset: bool = False


#: Fixed values.
POLICIES = {"market": Policy(24), "peer": Policy(720), "anchor": Policy(72), "gmp": Policy(24, 0, True)}


def freshness(as_of: Column, moment: Column, policy: Policy, raw_offset: Column | None = None) -> Column:
    """MISSING, FUTURE, STALE or FRESH at a given moment (never the current time)."""
    age = age_hours(moment, as_of)
    out = F.when(as_of.isNull(), "MISSING")
    if policy.offset and raw_offset is not None:
        out = out.when(~raw_offset, "MISSING")
    return out.when(age < -policy.future_hours, "FUTURE").when(age > policy.most_hours, "STALE").otherwise("FRESH")


def market_status(present: Column, as_of: Column, moment: Column) -> Column:
    """MISSING, STALE (over 24 hours old, over 1 hour ahead, or undated) or FRESH."""
    age = age_hours(moment, as_of)
    return F.when(~present, "MISSING").when(as_of.isNull() | (age > 24) | (age < -1), "STALE").otherwise("FRESH")


def peer_status(multiple: Column, match: Column, listed_years: Column, as_of: Column, moment: Column, least_years: float = 1.0, most_days: float = 30.0) -> Column:
    """MISSING, UNUSABLE (another business, or listed too short), STALE (undated or old) or VALID.

    A date ahead of the moment has a negative age and is VALID.
    """
    return F.when(multiple.isNull(), "MISSING").when(~match, "UNUSABLE").when(listed_years < least_years, "UNUSABLE").when(as_of.isNull(), "STALE").when(age_days(moment, as_of) > most_days, "STALE").otherwise("VALID")


def cut_off(status: Column, as_of: Column, cutoff: Column) -> Column:
    """A signal taken after its cutoff is demoted to STALE."""
    return F.when((status == "FRESH") & (as_of > cutoff), "STALE").otherwise(status)


def reconciled(rows: DataFrame, keys: list[str], order: list[Column], value: str, tolerance: float = 0.001) -> DataFrame:
    """One row for each key, the first in `order`, with `is_conflict` where values differ by more than `tolerance`."""
    group = Window.partitionBy(*keys)
    spread = F.max(value).over(group) - F.min(value).over(group)
    return rows.withColumn("is_conflict", spread > tolerance).withColumn("__n", F.row_number().over(group.orderBy(*order))).where("__n = 1").drop("__n")


def first_known(*candidates: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, source): of named candidates the first that isn't null."""
    value = F.coalesce(*[c for _, c in candidates])
    source = F.lit(None).cast("string")
    for name, c in reversed(candidates):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return value, source
