"""Policies compiled to columns: three-valued predicates, bands, criteria, knockouts, penalties, verdicts.

A metric is a column of its name; it is null unless the metric has a value. A
boolean column <metric>__na, where there is one, tells NOT_APPLICABLE from
UNKNOWN. SQL's null logic is the three-valued logic that policies ask for, so a
tree of conditions becomes one boolean column, null where it can't be told.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq}
SCORED, UNKNOWN, NOT_APPLICABLE, EXCLUDED = "SCORED", "UNKNOWN", "NOT_APPLICABLE", "EXCLUDED_BY_MODE"


def leaf(spec: Mapping[str, Any], columns: Sequence[str]) -> Column:
    """{metric, op, value}, {metric, in: [...]} or {flag}; null for a metric that isn't there."""
    name = spec.get("metric", spec.get("flag"))
    if name not in columns:
        return F.lit(None).cast("boolean")
    value = F.col(name)
    if "flag" in spec:
        return value.cast("boolean") == F.lit(spec.get("equals", True))
    if "in" in spec or spec.get("op") == "in":
        return value.isin(list(spec.get("in", spec.get("value"))))
    return COMPARE[spec["op"]](value, F.lit(spec["value"]))


def truth(tree: Mapping[str, Any], columns: Sequence[str]) -> Column:
    """A tree of all, any, not and leaves by Kleene's logic."""
    if "all" in tree:
        return reduce(operator.and_, [truth(t, columns) for t in tree["all"]], F.lit(True))
    if "any" in tree:
        return reduce(operator.or_, [truth(t, columns) for t in tree["any"]], F.lit(False))
    if "not" in tree:
        return ~truth(tree["not"], columns)
    return leaf(tree, columns)


def two_valued(tree: Mapping[str, Any], columns: Sequence[str]) -> Column:
    """As overlays ask: a leaf that can't be told is false."""
    if "all" in tree:
        return reduce(operator.and_, [two_valued(t, columns) for t in tree["all"]], F.lit(True))
    if "any" in tree:
        return reduce(operator.or_, [two_valued(t, columns) for t in tree["any"]], F.lit(False))
    if "not" in tree:
        return ~two_valued(tree["not"], columns)
    return F.coalesce(leaf(tree, columns), F.lit(False))


def leaves(tree: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    below = tree.get("all") or tree.get("any") or ([tree["not"]] if "not" in tree else None)
    return [tree] if below is None else [x for t in below for x in leaves(t)]


def trace(tree: Mapping[str, Any], columns: Sequence[str]) -> Column:
    """Each leaf with its outcome: TRUE, FALSE or UNKNOWN."""
    told = lambda c: F.when(c.isNull(), "UNKNOWN").when(c, "TRUE").otherwise("FALSE")
    return F.array(*[F.struct(F.lit(x.get("metric", x.get("flag"))).alias("metric"), F.lit(str(x.get("op", "in" if "in" in x else "flag"))).alias("op"), told(leaf(x, columns)).alias("outcome")) for x in leaves(tree)])


def any_unknown(tree: Mapping[str, Any], columns: Sequence[str]) -> Column:
    return reduce(operator.or_, [leaf(x, columns).isNull() for x in leaves(tree)], F.lit(False))


def banded(value: Column, table: Mapping[str, Any]) -> Column:
    """Score of the first band (operator, threshold, score) that a value meets, else the table's; null for null."""
    out = None
    for op, threshold, points in table.get("bands", []):
        hit = COMPARE[op](value, F.lit(float(threshold)))
        out = F.when(hit, float(points)) if out is None else out.when(hit, float(points))
    rest = F.lit(float(table.get("else", 0)))
    return F.when(value.isNotNull(), rest if out is None else out.otherwise(rest))


def verdict(points: Column, bands: Sequence[Mapping[str, Any]], otherwise: str = "AVOID") -> Column:
    """The first band whose `min` the points reach."""
    out = F.when(points.isNull(), F.lit(None))
    for band in bands:
        out = out.when(points >= F.lit(float(band["min"])), band["verdict"])
    return out.otherwise(otherwise)


def criterion(spec: Mapping[str, Any], columns: Sequence[str], excluded: Sequence[str] = ()) -> tuple[Column, Column]:
    """(state, points) of a criterion. Points are null unless SCORED."""
    if spec["id"] in excluded:
        return F.lit(EXCLUDED), F.lit(None).cast("double")
    if "when" in spec and not spec.get("metric"):
        fires = truth(spec["when"], columns)
        return F.when(fires.isNull(), UNKNOWN).otherwise(SCORED), F.when(fires, float(spec.get("points", 0))).when(~fires, 0.0)
    name, most = spec["metric"], float(spec.get("max", 0))
    there = name in columns
    value = F.col(name) if there else F.lit(None).cast("double")
    apart = F.coalesce(F.col(f"{name}__na"), F.lit(False)) if f"{name}__na" in columns else F.lit(False)
    rule = spec["rule"]
    if rule["type"] == "categorical":
        points, text = F.lit(None).cast("double"), value.cast("string")
        for key, score in rule["map"].items():
            points = F.when(text == key, float(score)).otherwise(points)
    elif rule["type"] == "bands":
        points = banded(value.cast("double"), rule)
    else:
        points, variant = F.lit(None).cast("double"), F.col(rule["variant_metric"]).cast("string")
        for key, table in rule["variants"].items():
            points = F.when(variant == key, banded(value.cast("double"), table)).otherwise(points)
    if "cap_if" in spec:
        capped = F.coalesce(truth(spec["cap_if"], columns), F.lit(False))
        points = F.when(capped, F.least(points, F.lit(float(spec["cap_if"]["cap"])))).otherwise(points)
    points = F.when(points.isNotNull(), F.least(points, F.lit(most)))
    exempt = F.coalesce(truth(spec["exempt_if"], columns), F.lit(False)) if "exempt_if" in spec else F.lit(False)
    if "exempt_if" in spec:
        points = F.when(exempt & value.isNotNull(), float(spec["exempt_if"].get("score", 0))).otherwise(points)
    zero = F.coalesce(truth(spec["zero_if"], columns), F.lit(False)) if "zero_if" in spec else F.lit(False)
    points = F.when(zero, 0.0).otherwise(points)
    state = F.when(points.isNotNull(), SCORED).when(value.isNull() & apart, NOT_APPLICABLE).otherwise(UNKNOWN)
    return state, points


def judged(df: DataFrame, policy: Mapping[str, Any], mode: str = "final") -> Column:
    """A row's criteria: an array of (module, criterion, kind, max, state, points)."""
    excluded = policy.get("modes", {}).get(mode, {}).get("exclude", [])
    made = []
    for module in policy["modules"]:
        for spec in module["criteria"]:
            state, points = criterion(spec, df.columns, excluded)
            made.append(F.struct(F.lit(module["id"]).alias("module"), F.lit(spec["id"]).alias("criterion"), F.lit(spec.get("kind", "criterion")).alias("kind"), F.lit(float(spec.get("max", 0))).alias("max"), state.alias("state"), points.alias("points")))
    return F.array(*made)


def criteria(df: DataFrame, key: str, policy: Mapping[str, Any], mode: str = "final") -> DataFrame:
    """One row for each row of `df` and each criterion: key, module, criterion, kind, max, state, points."""
    return df.select(key, F.explode(judged(df, policy, mode)).alias("c")).select(key, "c.*")


def totalled(own: Column, policy: Mapping[str, Any]) -> Column:
    """A row's modules, from its criteria (`judged`): an array of (module, score, available_points, unknown_points, not_applicable_points).

    A score is positives and penalties together, 0 at least. The criteria are
    the row's own, so nothing is moved.
    """

    def of(module: str) -> Column:
        mine = F.filter(own, lambda c: c["module"] == module)
        plain = lambda state: F.aggregate(F.filter(mine, lambda c: (c["kind"] != "penalty") & (c["state"] == state)), F.lit(0.0), lambda a, c: a + c["max"])
        score = F.greatest(F.lit(0.0), F.aggregate(mine, F.lit(0.0), lambda a, c: a + F.coalesce(c["points"], F.lit(0.0))))
        return F.struct(F.lit(module).alias("module"), score.alias("score"), plain(SCORED).alias("available_points"), plain(UNKNOWN).alias("unknown_points"), plain(NOT_APPLICABLE).alias("not_applicable_points"))

    return F.array(*[of(m["id"]) for m in policy["modules"] if m["criteria"]])


def modules(df: DataFrame, key: str, policy: Mapping[str, Any], mode: str = "final") -> DataFrame:
    """One row for each row of `df` and each module: key, module, score, and the points by state."""
    own = df.select(key, judged(df, policy, mode).alias("__criteria"))
    return own.select(key, F.explode(totalled(F.col("__criteria"), policy)).alias("m")).select(key, "m.*")


def penalties(df: DataFrame, policy: Mapping[str, Any]) -> tuple[Column, Column]:
    """(total, reserve): applied points, no lower than the policy's floor, and the size of those that can't be told."""
    spec = policy.get("penalties", {})
    total, reserve = F.lit(0.0), F.lit(0.0)
    for item in spec.get("items", []):
        if "scale" in item:
            text = F.col(item["metric"]).cast("string") if item["metric"] in df.columns else F.lit(None).cast("string")
            points = F.lit(0.0)
            for key, value in item["scale"].items():
                points = F.when(text == key, float(value)).otherwise(points)
            total = total + F.when(text.isNotNull(), points).otherwise(0.0)
            reserve = reserve + F.when(text.isNull(), max(abs(float(v)) for v in item["scale"].values())).otherwise(0.0)
        else:
            fires = truth(item["when"], df.columns)
            total = total + F.when(fires, float(item["points"])).otherwise(0.0)
            reserve = reserve + F.when(fires.isNull(), abs(float(item["points"]))).otherwise(0.0)
    return F.greatest(total, F.lit(float(spec.get("max_total", -15)))), reserve


def knockouts(df: DataFrame, policy: Mapping[str, Any]) -> Column:
    """Each knockout with its status: TRIGGERED, CLEAR or UNVERIFIED."""
    made = []
    for rule in policy.get("knockouts", []):
        fires = truth(rule["when"], df.columns)
        known = reduce(operator.and_, [F.col(m).isNotNull() if m in df.columns else F.lit(False) for m in rule.get("required", [])], F.lit(True))
        made.append(F.struct(F.lit(rule["id"]).alias("id"), F.when(fires, "TRIGGERED").when(fires.isNull() | ~known, "UNVERIFIED").otherwise("CLEAR").alias("status")))
    return F.array(*made) if made else F.array().cast("array<struct<id:string,status:string>>")


def overall(status: Column) -> Column:
    """TRIGGERED over UNVERIFIED over CLEAR."""
    has = lambda s: F.exists(status, lambda k: k["status"] == s)
    return F.when(has("TRIGGERED"), "TRIGGERED").when(has("UNVERIFIED"), "UNVERIFIED").otherwise("CLEAR")


def capped(points: Column, policy: Mapping[str, Any], columns: Sequence[str]) -> Column:
    for cap in policy.get("caps", []) or []:
        points = F.when(F.coalesce(truth(cap["when"], columns), F.lit(False)), F.least(points, F.lit(float(cap["max_score"])))).otherwise(points)
    return points


def evaluate(df: DataFrame, key: str, policy: Mapping[str, Any], mode: str = "final") -> DataFrame:
    """Scores, bounds, completeness, knockouts and verdict of each row of `df`, by `policy`."""
    total, reserve = penalties(df, policy)
    full = df.withColumns({"__penalty": total, "__reserve": reserve, "knockouts": knockouts(df, policy), "__criteria": judged(df, policy, mode)})
    # A projection of its own for each step: what the next one uses more than once is computed once.
    full = full.withColumn("__modules", totalled(F.col("__criteria"), policy))
    sums = {"base_score": "score", **{c: c for c in ("available_points", "unknown_points", "not_applicable_points")}}
    summed = lambda field: F.aggregate("__modules", F.lit(0.0), lambda a, m: a + m[field])
    full = full.withColumns({name: summed(field) for name, field in sums.items()})
    cap = lambda c: capped(c, policy, df.columns)
    zero, base = F.lit(0.0), F.col("base_score")
    final = cap(F.greatest(zero, base + F.col("__penalty")))
    low = cap(F.greatest(zero, base + F.col("__penalty") - F.col("__reserve")))
    high = cap(F.greatest(zero, base + F.col("unknown_points") + F.col("__penalty")))
    all_points = F.col("available_points") + F.col("unknown_points")
    complete = F.when(all_points > 0, F.col("available_points") / all_points * 100.0).otherwise(0.0)
    confidence, spec = policy.get("confidence", {}), policy.get("verdict", {})
    band = lambda c: verdict(c, spec.get("bands", []), spec.get("else", "AVOID"))
    critical = policy.get("critical_data", {}).get("items", [])
    missing = reduce(operator.or_, [F.col(m).isNull() if m in df.columns else F.lit(True) for m in critical], F.lit(False))
    told = (
        F.when(overall(F.col("knockouts")) == "TRIGGERED", spec.get("knockout_verdict", "AVOID")).when(missing, confidence.get("low_verdict", "INSUFFICIENT_DATA"))
        .when(band(low) != band(high), spec.get("uncertain_verdict", "VERDICT_UNCERTAIN")).otherwise(band(final))
    )
    return full.select(
        key, "base_score", F.col("__penalty").alias("penalties_total"), final.alias("final_score"), low.alias("lower_bound"), high.alias("upper_bound"), "available_points", "unknown_points", "not_applicable_points", F.round(complete, 6).alias("completeness_pct"),
        F.when(complete >= confidence.get("high_min_completeness_pct", 95), "High").when(complete >= confidence.get("medium_min_completeness_pct", 80), "Medium").otherwise("Low").alias("confidence"),
        overall(F.col("knockouts")).alias("knockout_status"), told.alias("verdict"),
    )


def overlaid(policy: Mapping[str, Any], overlays: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    """The policy with criteria removed, replaced or added by each overlay (remove, override, add by module), in order.

    A module's maximum follows from its criteria where an overlay changes them.
    """
    out = {**policy, "modules": [{**m, "criteria": [dict(c) for c in m["criteria"]]} for m in policy["modules"]]}
    for overlay in overlays:
        for module in out["modules"]:
            gone, changed = set(overlay.get("remove", [])), overlay.get("override", {})
            module["criteria"] = [{**c, **changed.get(c["id"], {})} for c in module["criteria"] if c["id"] not in gone] + [dict(c) for c in overlay.get("add", {}).get(module["id"], [])]
            module["max"] = sum(float(c.get("max", 0)) for c in module["criteria"] if c.get("kind") != "penalty")
    return out


def resolved_plan(df: DataFrame, policy: Mapping[str, Any], requested: Column | None = None) -> DataFrame:
    """`df` with profile, structures (names of the structure overlays that apply) and untold (of those whose trigger can't be told, which don't).

    The requested profile (STANDARD, unless told) gives way to the first automatic
    rule that holds and doesn't except it.
    """
    start = F.lit("STANDARD") if requested is None else requested
    profile = start
    for rule in reversed((policy.get("profile_resolution") or {}).get("auto_rules", [])):
        kept = start.isin(list(rule.get("unless_profile", []))) if rule.get("unless_profile") else F.lit(False)
        profile = F.when(two_valued(rule["when"], df.columns) & ~kept, rule["profile"]).otherwise(profile)
    structures = [(n, o["when"]) for n, o in (policy.get("structure_overlays") or {}).items() if "when" in o]
    some = lambda test: F.filter(F.array(*[F.when(test(t), n) for n, t in structures]).cast("array<string>"), lambda x: x.isNotNull())
    holds = lambda t: two_valued(t, df.columns)
    return df.withColumns({"profile": profile, "structures": some(holds), "untold": some(lambda t: ~holds(t) & any_unknown(t, df.columns))})


def evaluate_planned(df: DataFrame, key: str, policy: Mapping[str, Any], requested: Column | None = None, mode: str = "final", total: float | None = None) -> DataFrame:
    """`evaluate` with the overlays that each row's profile and structures ask for, and these beside it.

    Plans are the distinct combinations, a few for any number of rows; each is
    compiled once. A profile without an overlay is an error, and so is a plan
    whose maxima don't add up to `total`, where that is told.
    """
    rows = resolved_plan(df, policy, requested)
    out = None
    for profile, structures in sorted(((r[0], tuple(r[1])) for r in rows.select("profile", "structures").distinct().collect())):
        chosen = []
        if profile != "STANDARD":
            if profile not in (policy.get("sector_overlays") or {}):
                raise ValueError(f"OVERLAY_SELECTED_BUT_NOT_IMPLEMENTED: {profile}")
            chosen.append(policy["sector_overlays"][profile])
        plan = overlaid(policy, [*chosen, *[policy["structure_overlays"][n] for n in structures]])
        held = sum(m["max"] for m in plan["modules"]) if chosen or structures else None
        if total is not None and held is not None and abs(held - total) > 1e-9:
            raise ValueError(f"the plan of {profile} with {structures} adds up to {held}, not {total}")
        own = rows.where((F.col("profile") == profile) & (F.col("structures") == F.array(*[F.lit(n) for n in structures]).cast("array<string>")))
        made = evaluate(own, key, plan, mode).withColumns({"profile": F.lit(profile), "structures": F.lit(",".join(structures))})
        out = made if out is None else out.unionByName(made)
    return out if out is not None else evaluate(rows, key, policy, mode).withColumns({"profile": F.lit("STANDARD"), "structures": F.lit("")})


def domain_gaps(domain: Sequence[str], mapped: Sequence[str]) -> tuple[list[str], list[str]]:
    """Categories without a score, and scores without a category."""
    return sorted(set(domain) - set(mapped)), sorted(set(mapped) - set(domain))


def stepwise(start: Column, deltas: Column, most: float) -> Column:
    """`start` changed by each delta in turn, kept within 0 and `most` at every step."""
    return F.aggregate(deltas, start.cast("double"), lambda a, d: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), a + d)))
