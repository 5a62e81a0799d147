"""Workflow of evaluations: gaps, candidate fields, enrichment, lifecycle requests, supplements and secondary evaluations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import hashing, metrics, rules
from quillmark.operators.versions import latest

#: The next step that a gap of a category asks for.
NEXT_STEPS = {"CRITERION": "INSPECT_CRITERION", "KNOCKOUT": "INSPECT_KNOCKOUT", "PEER": "INSPECT_PEER", "MARKET": "INSPECT_MARKET", "PENALTY": "INSPECT_PENALTY", "CRITICAL_DATA": "INSPECT_CRITICAL_INPUT"}


def gaps(missing: DataFrame, criteria: DataFrame, key: str = "evaluation_id") -> DataFrame:
    """The missing rows of evaluations with their criterion's module, what is known of their effect on the score, and the next step.

    missing: key, category, item, state, detail, points_affected. criteria: key,
    criterion, module. Only criteria have a module; an effect is established
    where points are told and positive.
    """
    modules = criteria.select(F.col(key).alias("__k"), F.col("criterion").alias("__c"), F.col("module").alias("module"))
    met = missing.join(modules, (missing[key] == modules["__k"]) & (missing["category"] == "CRITERION") & (missing["item"] == modules["__c"]), "left").drop("__k", "__c")
    told = F.coalesce(F.col("points_affected") > 0, F.lit(False))
    steps = F.create_map(*[F.lit(x) for kv in NEXT_STEPS.items() for x in kv])
    return met.withColumns({
        "effect": F.when(told, "ESTABLISHED_BY_BASELINE").otherwise("NOT_ESTABLISHED_BY_AVAILABLE_ARTIFACTS"), "points_affected": F.when(told, F.col("points_affected")),
        "reason": F.when(F.coalesce(F.col("detail"), F.lit("")) != "", "STORED_EXPLANATION").otherwise("UNDETERMINED"), "next_step": F.coalesce(F.try_element_at(steps, F.col("category")), F.lit("INSPECT_ARTIFACTS")),
    })


def resolved_fields(candidates: DataFrame, issues: DataFrame, fields: Sequence[str], key: str = "ipo_id") -> DataFrame:
    """(key, field, state, value, source, unverified_disagrees) for each issue and field.

    candidates: key, field, value, source, rank (order of preference), issuer,
    open_date, close_date, valid, verified. issues: key, issuer, open_date,
    close_date. A candidate of another issuer, or of another window where both
    tell one, isn't looked at. Verified and valid candidates that agree give
    VERIFIED and the first one's value; if they differ, CONFLICT. Valid but
    unverified ones await verification.
    """
    known = issues.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("issuer", "open_date", "close_date")])
    met = candidates.join(known, candidates[key] == known["__k"])
    other = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != F.col(f"__{c}"), F.lit(False)) for c in ("open_date", "close_date")])
    usable = met.where((F.col("issuer") == F.col("__issuer")) & ~other)
    good = F.col("valid") & F.col("verified")
    value = F.when(good, F.col("value"))
    first = F.min(F.when(good, F.struct("rank", "source", "value")))
    told = usable.groupBy(key, "field").agg(
        F.count_distinct(value).alias("values"), F.bool_or(good).alias("good"), F.bool_or("valid").alias("valid"), first.alias("first"), F.collect_set(F.when(F.col("valid") & ~F.col("verified"), F.col("value"))).alias("loose"), F.min(value).alias("low")
    )
    state = F.when(F.col("values") > 1, "CONFLICT").when(F.col("good"), "VERIFIED").when(F.col("valid"), "CANDIDATE_AWAITING_VERIFICATION").otherwise("MALFORMED_OR_AMBIGUOUS")
    told = told.select(F.col(key).alias("__k"), F.col("field").alias("__f"), state.alias("state"), "first", (F.col("good") & F.exists("loose", lambda v: v != F.col("low"))).alias("unverified_disagrees"))
    every = issues.select(key, F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    out = every.join(told, (every[key] == told["__k"]) & (every["field"] == told["__f"]), "left")
    verified = F.col("state") == "VERIFIED"
    return out.select(key, "field", F.coalesce("state", F.lit("UNRESOLVED_AFTER_DISCOVERY")).alias("state"), F.when(verified, F.col("first.value")).alias("value"), F.when(verified, F.col("first.source")).alias("source"), F.coalesce("unverified_disagrees", F.lit(False)).alias("unverified_disagrees"))


def owned(base: DataFrame, given: DataFrame, key: str, own: Sequence[str], code: str, allow: bool = False) -> tuple[DataFrame, DataFrame]:
    """`base` with the columns `own` filled from `given` where they are null, and a finding for each other column that `given` tells.

    For statutory facts `own` is empty: nothing of a template is taken, and each
    attempt is a warning (unless `allow`, when the template fills all). For an
    analyst it is the ratings.
    """
    names = [c for c in given.columns if c != key]
    side = given.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in names])
    met = base.join(side, base[key] == side["__k"], "left")
    taken = names if allow else [c for c in names if c in own]
    out = met.withColumns({c: F.coalesce(c, f"__{c}") for c in taken if c in base.columns}).select(*base.columns)
    refused = [c for c in names if c not in taken]
    attempts = F.filter(F.array(*[F.when(F.col(f"__{c}").isNotNull(), F.lit(c)) for c in refused]), lambda x: x.isNotNull()) if refused else F.array().cast("array<string>")
    return out, met.select(key, F.explode(attempts).alias("location")).select(key, F.lit(code).alias("code"), F.lit("WARNING").alias("severity"), "location")


def by_alias(payload: DataFrame, aliases: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """Snapshot fields by the first of their names that tells anything."""
    have = set(payload.columns)
    return payload.select(*keep, *[F.coalesce(*[F.col(a) for a in names if a in have], F.lit(None)).alias(field) for field, names in aliases.items()])


#: From which variance, in percent (promoter_post_pct: in points), a disclosed value is told apart from the derived one.
VARIANCE = {"fresh_shares": 1.0, "post_issue_shares": 1.0, "ofs": 1.0, "post_issue_eps": 2.0, "promoter_post_disclosed": 1.0}


def derived_fields(issues: DataFrame) -> DataFrame:
    """`issues` with five fields filled where they are null, and <field>_variance where a disclosed value can be held against the derived one.

    Columns as in `quillmark.functions.metrics`, amounts in crore. Disclosed
    values are kept. unreconciled lists the fields beyond VARIANCE.
    """
    crore = 1e7
    shares = F.round(F.col("fresh_issue") * crore / F.when(F.col("price_band_high") > 0, F.col("price_band_high")))
    fresh = F.coalesce("fresh_shares", shares)
    after = F.col("pre_issue_shares") + fresh
    final = F.coalesce("post_issue_shares", after)
    sold = F.when(F.size("sellers") > 0, F.aggregate("sellers", F.lit(0.0), lambda a, s: a + s["shares_sold"]))
    own = F.filter("sellers", lambda s: s["type"].isin(*metrics.PROMOTERS))
    made = {
        "fresh_shares": shares, "post_issue_shares": after, "ofs": sold * F.col("price_band_high") / crore, "post_issue_eps": F.round(F.element_at(F.filter("periods", lambda p: ~F.coalesce(p["is_stub"], F.lit(False))), -1)["pat"] * crore / F.when(final > 0, final), 2),
        "promoter_post_disclosed": (F.col("promoter_pre_pct") / 100 * F.col("pre_issue_shares") - F.aggregate(own, F.lit(0.0), lambda a, s: a + s["shares_sold"])) / F.when(final > 0, final) * 100,
    }
    apart = {f: F.abs(F.col(f) - made[f]) if f == "promoter_post_disclosed" else F.abs(F.col(f) - made[f]) / F.when(made[f] != 0, F.abs(made[f])) * 100 for f in VARIANCE}
    out = issues.withColumns({**{f"{f}_variance": apart[f] for f in VARIANCE}, **{f"__{f}": F.coalesce(F.col(f), made[f]) for f in VARIANCE}})
    out = out.withColumns({f: F.col(f"__{f}") for f in VARIANCE}).drop(*[f"__{f}" for f in VARIANCE])
    far = [F.when(F.col(f"{f}_variance") > most, F.lit(f)) for f, most in VARIANCE.items()]
    return out.withColumn("unreconciled", F.filter(F.array(*far), lambda x: x.isNotNull()))


def dispositions(issues: DataFrame, key: str, preserved: Sequence[str], assembled: Sequence[str], derived: Sequence[str] = ()) -> DataFrame:
    """(key, field, disposition): PRESERVED from the filing, ASSEMBLED from snapshots, DERIVED, or UNKNOWN where nothing is told."""
    kinds = [*[(f, "PRESERVED") for f in preserved], *[(f, "ASSEMBLED") for f in assembled], *[(f, "DERIVED") for f in derived]]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), kind).otherwise("UNKNOWN").alias("disposition")) for f, kind in kinds])
    return issues.select(key, F.explode(each).alias("x")).select(key, "x.*")


def protection(evaluations: DataFrame, observed: DataFrame, golden: Column, key: str = "evaluation_id") -> DataFrame:
    """`evaluations` with tier: GOLDEN (as the caller's condition tells), GOVERNED (it has observations) or STANDARD."""
    seen = observed.select(F.col(key).alias("__o")).distinct()
    met = evaluations.join(seen, evaluations[key] == seen["__o"], "left")
    return met.withColumn("tier", F.when(F.coalesce(golden, F.lit(False)), "GOLDEN").when(F.col("__o").isNotNull(), "GOVERNED").otherwise("STANDARD")).drop("__o")


def requested(evaluations: DataFrame, requests: DataFrame, key: str = "evaluation_id") -> DataFrame:
    """(request's columns, outcome, state, visibility): what becomes of requests to archive, unarchive or activate.

    evaluations: key, state (ACTIVE or SUPERSEDED), visibility (VISIBLE or
    ARCHIVED), tier, ratified, withdrawn. requests: key, action, and `at`; of
    several for one evaluation the first counts. A refused request leaves the
    evaluation as it is. Unarchived evaluations are superseded until they are
    activated.
    """
    first = latest(requests, [key], [F.col("at"), F.col("action")])
    known = evaluations.select(F.col(key).alias("__k"), "state", "visibility", "tier", "ratified", "withdrawn")
    met = first.join(known, first[key] == known["__k"], "left")
    action, archived = F.col("action"), F.col("visibility") == "ARCHIVED"
    outcome = (
        F.when(F.col("__k").isNull(), "NOT_FOUND")
        .when(action == "archive", F.when(F.col("tier") == "GOLDEN", "PROTECTED").when((F.col("state") == "ACTIVE") & ~F.coalesce("withdrawn", F.lit(False)), "ACTIVE_EVALUATION").when(archived, "ALREADY_ARCHIVED").otherwise("DONE"))
        .when(action == "unarchive", F.when(~archived, "NOT_ARCHIVED").otherwise("DONE"))
        .when(action == "activate", F.when(~F.coalesce("ratified", F.lit(False)), "UNRATIFIED_POLICY").when(archived, "ARCHIVED").otherwise("DONE")).otherwise("UNKNOWN_ACTION")
    )
    done = outcome == "DONE"
    state = F.when(done & (action == "activate"), "ACTIVE").when(done & (action == "unarchive"), "SUPERSEDED").otherwise(F.col("state"))
    seen = F.when(done & (action == "archive"), "ARCHIVED").when(done & (action == "unarchive"), "VISIBLE").otherwise(F.col("visibility"))
    return met.select(*first.columns, outcome.alias("outcome"), state.alias("state"), seen.alias("visibility"))


def admitted(entries: DataFrame, registry: DataFrame, open_gaps: DataFrame, established: DataFrame, key: str = "evaluation_id") -> DataFrame:
    """`entries` with errors, an array of codes; an entry without any is admitted.

    entries: key, target, value (double), source_type, observation_time,
    artifact_digest, stated_digest. registry: target, gap_item, minimum, maximum,
    source_type, needs_time. open_gaps: key, item. established: key, target.
    """
    rule = registry.select(F.col("target").alias("__target"), "gap_item", "minimum", "maximum", F.col("source_type").alias("__type"), "needs_time")
    gap = open_gaps.select(F.col(key).alias("__gk"), F.col("item").alias("__item")).distinct()
    there = established.select(F.col(key).alias("__ek"), F.col("target").alias("__et")).distinct()
    many = entries.groupBy(F.col(key).alias("__dk"), F.col("target").alias("__dt")).agg(F.count(F.lit(1)).alias("__n"))
    met = entries.join(rule, entries["target"] == rule["__target"], "left")
    met = met.join(gap, (met[key] == gap["__gk"]) & (met["gap_item"] == gap["__item"]), "left").join(there, (met[key] == there["__ek"]) & (met["target"] == there["__et"]), "left")
    met = met.join(many, (met[key] == many["__dk"]) & met["target"].eqNullSafe(many["__dt"]))
    supported = F.col("__target").isNotNull()
    codes = {
        "DUPLICATE_TARGET": F.col("__n") > 1, "UNSUPPORTED_TARGET": ~supported, "TARGET_NOT_A_BASELINE_GAP": supported & F.col("__item").isNull(), "TARGET_ALREADY_ESTABLISHED_IN_LAYER1": F.col("__et").isNotNull(),
        "VALUE_TYPE": supported & F.col("value").isNull(), "VALUE_RANGE": supported & ((F.col("value") < F.col("minimum")) | (F.col("value") > F.col("maximum"))), "OBSERVATION_TIME_REQUIRED": F.col("needs_time") & F.col("observation_time").isNull(),
        "SOURCE_TYPE_NOT_PERMITTED": supported & ~F.col("source_type").eqNullSafe(F.col("__type")), "SOURCE_ARTIFACT_MISSING": F.col("artifact_digest").isNull(), "SOURCE_ARTIFACT_HASH_MISMATCH": F.col("artifact_digest") != F.col("stated_digest"),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in codes.items()]), lambda c: c.isNotNull())
    return met.select(*entries.columns, found.alias("errors"))


def secondary(issues: DataFrame, entries: DataFrame, key: str, policy: Mapping[str, Any], targets: Mapping[str, str], names: list[str]) -> DataFrame:
    """(key, module, before, after, delta, evaluated_at): modules scored on the baseline and with admitted entries put in.

    entries: key, target, value, observation_time. targets: target -> column of
    the issue that it replaces. The secondary evaluation's time is the latest
    observation's. Issues without entries aren't in the result.
    """
    wide = entries.groupBy(F.col(key).alias("__k")).agg(F.max("observation_time").alias("evaluated_at"), *[F.max(F.when(F.col("target") == t, F.col("value"))).alias(f"__{c}") for t, c in targets.items()])
    base = metrics.complete(issues).join(wide, issues[key] == wide["__k"])
    changed = base.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in targets.values()})
    scored = lambda df: rules.modules(metrics.derive(df.drop("__k", "evaluated_at", *[f"__{c}" for c in targets.values()]), names), key, policy)
    before = scored(base).select(F.col(key).alias("__a"), F.col("module").alias("__m"), F.col("score").alias("before"))
    after = scored(changed).select(key, "module", F.col("score").alias("after"))
    met = after.join(before, (after[key] == before["__a"]) & (after["module"] == before["__m"]))
    times = wide.select(F.col("__k").alias("__t"), "evaluated_at")
    return met.join(times, met[key] == times["__t"]).select(key, "module", "before", "after", (F.col("after") - F.col("before")).alias("delta"), "evaluated_at")


def verified(rows: DataFrame, columns: Sequence[str], digest: str, order: Sequence[str] = ()) -> DataFrame:
    """`rows` with hash_matches: whether the stored digest is that of the canonical form of `columns`."""
    own = hashing.json_digest(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), wrapped=False)
    return rows.withColumn("hash_matches", F.col(digest).eqNullSafe(own))


def projected(rows: DataFrame, sections: Mapping[str, Sequence[str]]) -> DataFrame:
    """Records as canonical JSON: a nested object for each section, with its digest (integrity) beside it."""
    record = F.to_json(F.struct(*[F.struct(*columns).alias(name) for name, columns in sections.items()]), {"ignoreNullFields": "false"})
    return rows.withColumn("record", record).withColumn("integrity", hashing.json_digest(F.col("record"), wrapped=False))


#: Verdicts of a what-if.
SCENARIO_BANDS = [(75, "APPLY"), (60, "APPLY_SELECTIVELY"), (45, "NEUTRAL")]


def scenario(score: Column, modules: Sequence[tuple[Column, Column, float]], knocked_out: Column) -> tuple[Column, Column]:
    """(score, verdict) of a what-if.

    modules: (points before, array of deltas, cap); the deltas are put in one by
    one, each time clamped to 0..cap. The score is clamped to 0..100; a knockout
    means AVOID.
    """
    total = score
    for before, deltas, cap in modules:
        total = total + rules.stepwise(before, deltas, cap) - before
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))
    verdict = F.lit("AVOID")
    for least, name in reversed(SCENARIO_BANDS):
        verdict = F.when(total >= least, name).otherwise(verdict)
    return total, F.when(knocked_out, "AVOID").otherwise(verdict)


def full(evaluations: DataFrame, artifacts: Mapping[str, DataFrame], key: str = "evaluation_id") -> DataFrame:
    """Evaluations with a struct column for each kind of artifact (one row an evaluation), null where it isn't stored."""
    out = evaluations
    for name, table in artifacts.items():
        side = table.select(F.col(key).alias(f"__{name}"), F.struct(*[c for c in table.columns if c != key]).alias(name))
        out = out.join(side, out[key] == side[f"__{name}"], "left").drop(f"__{name}")
    return out
