"""Calibration of module weights: when it is allowed, one proposal, and its shadow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import stats
from quillmark.functions.returns import rescored
from quillmark.functions.rules import verdict

#: Points moved between modules, and the fall in holdout correlation that rejects it.
TILT, FALL = 5.0, 0.05


def gate(rows: DataFrame, year: str, leak_free: Column | None = None) -> DataFrame:
    """One row: n, vintages and tier of the rows that aren't invalid."""
    n, vintages = F.count(F.lit(1)), F.count_distinct(year)
    passed = F.lit(True) if leak_free is None else F.coalesce(F.bool_and(leak_free), F.lit(True))
    tier = F.when(~passed | (n < 30), "CALIBRATION_INELIGIBLE").when((n < 100) | (vintages < 3), "CALIBRATION_EXPLORATORY").otherwise("CALIBRATION_CANDIDATE")
    return rows.agg(n.alias("n"), vintages.alias("vintages"), tier.alias("tier"))


def tilted(rows: DataFrame, row_id: str, modules: Mapping[str, float], value: str, year: str) -> dict[str, Any]:
    """The proposal: TILT points from the module that correlates least with `value` before the last vintage to the one that does most.

    modules: column -> weight (also its maximum). Scores and returns are paired
    by row. The tilt is rejected if the last vintage's correlation falls by more
    than FALL. What reaches the driver is one coefficient for each module.
    """
    split = stats.holdout_split(rows.where(F.col(value).isNotNull()), year).where("is_holdout is not null").select(row_id, "is_holdout", value, *modules)
    long = split.where("not is_holdout").unpivot([row_id, value], list(modules), "module", "x")
    rho = {r["module"]: r["value"] for r in stats.rank_correlation(long, ["module"], "x", value).collect() if r["value"] is not None}
    ranked = sorted(rho, key=lambda m: (rho[m], m))
    weights = dict(modules)
    if len(ranked) < 2:
        return {"weights": weights, "status": "NO_CHANGE", "correlations": rho, "holdout": None}
    low, top = ranked[0], ranked[-1]
    trial = {**weights, top: weights[top] + TILT, low: weights[low] - TILT}
    score = lambda w: rescored([(F.col(m), modules[m], w[m]) for m in modules])
    both = split.where("is_holdout").select(value, F.explode(F.array(F.struct(F.lit("base").alias("k"), score(weights).alias("s")), F.struct(F.lit("trial").alias("k"), score(trial).alias("s")))).alias("x")).select(value, "x.*")
    held = {r["k"]: r["value"] for r in stats.rank_correlation(both, ["k"], "s", value).collect()}
    base, after = held.get("base"), held.get("trial")
    worse = base is not None and after is not None and after < base - FALL
    return {"weights": weights if worse else trial, "status": "REJECTED" if worse else "PROPOSED", "correlations": rho, "holdout": held, "from": low, "to": top}


def shadow(rows: DataFrame, base: Column, proposed: Column, value: str) -> DataFrame:
    """How verdicts move under another weighting: rows and mean return for each pair of verdicts."""
    return rows.groupBy(base.alias("base"), proposed.alias("shadow")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"))


def shadow_report(rows: DataFrame, before: str, after: str, bands: Sequence[Mapping[str, Any]], otherwise: str = "AVOID") -> DataFrame:
    """One row: how many verdicts shift under another score, up (a higher score) or down, and how scores move."""
    delta, moved = F.round(F.col(after) - F.col(before), 2), verdict(F.col(before), bands, otherwise) != verdict(F.col(after), bands, otherwise)
    up = F.col(after) > F.col(before)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(moved).alias("shifts"), F.count_if(moved & up).alias("upgrades"), F.count_if(moved & ~up).alias("downgrades"), F.count_if(~moved).alias("unchanged"),
        F.count_if(delta > 0).alias("increased"), F.count_if(delta < 0).alias("decreased"), F.round(F.avg(delta), 4).alias("mean_delta"),
    )


def changed_paths(old: Any, new: Any, at: str = "") -> list[tuple[str, Any, Any]]:
    """Where two policies differ: (dotted path, old, new), sorted."""
    if isinstance(old, Mapping) and isinstance(new, Mapping):
        return [c for k in sorted({*old, *new}) for c in changed_paths(old.get(k), new.get(k), f"{at}.{k}" if at else str(k))]
    return [] if old == new else [(at, old, new)]


def frozen_kept(old: Mapping[str, Any], new: Mapping[str, Any], frozen: Sequence[str]) -> list[str]:
    """Changed paths under parts of a policy that must not change."""
    return [p for p, _, _ in changed_paths(old, new) if any(p == f or p.startswith(f + ".") for f in frozen)]
