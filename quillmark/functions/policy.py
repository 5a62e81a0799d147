"""Checks of a policy before it scores anything: (code, location, message), in order of the policy's parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from quillmark.functions import metrics
from quillmark.functions.rules import COMPARE, domain_gaps, overlaid

Finding = tuple[str, str, str]
#: Fixed values.
RULES, VARIANTS = ("bands", "categorical", "bands_by_variant"), ("hot", "normal")


def expression(tree: Any, at: str, known: Sequence[str]) -> list[Finding]:
    """A condition's faults: empty or unknown forms, operators, values, and metrics that aren't registered."""
    if not isinstance(tree, Mapping) or not tree:
        return [("CONFIG_EXPR_EMPTY", at, "an empty condition")]
    for form in ("all", "any"):
        if form in tree:
            return [("CONFIG_EXPR_EMPTY", f"{at}.{form}", "no conditions")] if not tree[form] else [f for i, t in enumerate(tree[form]) for f in expression(t, f"{at}.{form}[{i}]", known)]
    if "not" in tree:
        return expression(tree["not"], f"{at}.not", known) if isinstance(tree["not"], Mapping) else [("CONFIG_EXPR_NOT_TYPE", at, "not takes one condition")]
    if "flag" in tree:
        return [] if tree["flag"] in known else [("CONFIG_FLAG_UNIMPLEMENTED", at, str(tree["flag"]))]
    if "metric" not in tree:
        return [("CONFIG_EXPR_UNKNOWN", at, str(sorted(tree)))]
    out = [] if tree["metric"] in known else [("CONFIG_METRIC_UNIMPLEMENTED", at, str(tree["metric"]))]
    if "in" in tree:
        return out + ([] if isinstance(tree["in"], (list, tuple)) and tree["in"] else [("CONFIG_OPERATOR_VALUE", at, "in takes a list")])
    if "op" not in tree:
        return [*out, ("CONFIG_EXPR_NO_OPERATOR", at, "")]
    if tree["op"] not in (*COMPARE, "in"):
        out.append(("CONFIG_OPERATOR_INVALID", at, str(tree["op"])))
    return out if "value" in tree else [*out, ("CONFIG_EXPR_NO_VALUE", at, "")]


def _bands(rule: Mapping[str, Any], at: str, most: float) -> list[Finding]:
    out: list[Finding] = []
    if not rule.get("bands"):
        out.append(("CONFIG_BANDS_EMPTY", at, ""))
    if "else" not in rule:
        out.append(("CONFIG_BANDS_NO_ELSE", at, ""))
    scores = [("else", rule["else"])] if "else" in rule else []
    for i, band in enumerate(rule.get("bands") or []):
        if not isinstance(band, (list, tuple)) or len(band) != 3:
            out.append(("CONFIG_BAND_SHAPE", f"{at}.bands[{i}]", str(band)))
            continue
        if band[0] not in COMPARE:
            out.append(("CONFIG_OPERATOR_INVALID", f"{at}.bands[{i}]", str(band[0])))
        scores.append((f"bands[{i}]", band[2]))
    return out + _scores(scores, at, most, "CONFIG_BAND_SCORE")


def _scores(scores: Sequence[tuple[str, Any]], at: str, most: float, wrong: str) -> list[Finding]:
    out: list[Finding] = []
    for place, score in scores:
        if not isinstance(score, (int, float)) or isinstance(score, bool):
            out.append((wrong, f"{at}.{place}", str(score)))
        elif score > most:
            out.append(("CONFIG_SCORE_EXCEEDS_MAX", f"{at}.{place}", f"{score} > {most}"))
        elif score < 0:
            out.append(("CONFIG_NEGATIVE_SCORE", f"{at}.{place}", str(score)))
    return out


def _criterion(spec: Mapping[str, Any], at: str, known: Sequence[str], domains: Mapping[str, Sequence[str]]) -> list[Finding]:
    out: list[Finding] = []
    if spec.get("kind") == "penalty":
        return expression(spec["when"], f"{at}.when", known) if "when" in spec else [("CONFIG_PENALTY_NO_WHEN", at, "")]
    if "max" not in spec:
        out.append(("CONFIG_CRITERION_NO_MAX", at, ""))
    most = float(spec.get("max") or 0)
    if "metric" not in spec:
        out.append(("CONFIG_CRITERION_NO_METRIC", at, ""))
    elif spec["metric"] not in known:
        out.append(("CONFIG_METRIC_UNIMPLEMENTED", at, str(spec["metric"])))
    for part in ("zero_if", "exempt_if", "cap_if"):
        if part in spec:
            out += expression(spec[part].get("when", spec[part]), f"{at}.{part}", known)
    rule = spec.get("rule")
    if not rule:
        return [*out, ("CONFIG_CRITERION_NO_RULE", at, "")]
    if rule.get("type") not in RULES:
        return [*out, ("CONFIG_RULE_TYPE_INVALID", at, str(rule.get("type")))]
    if rule["type"] == "bands":
        return out + _bands(rule, f"{at}.rule", most)
    if rule["type"] == "bands_by_variant":
        tables = rule.get("variants") or {}
        if not tables:
            return [*out, ("CONFIG_VARIANTS_EMPTY", at, "")]
        if set(VARIANTS) - set(tables):
            out.append(("CONFIG_VARIANTS_INCOMPLETE", at, str(sorted(set(VARIANTS) - set(tables)))))
        return out + [f for name, table in tables.items() for f in _bands(table, f"{at}.rule.{name}", most)]
    mapped = rule.get("map") or {}
    if not mapped:
        return [*out, ("CONFIG_CATEGORICAL_EMPTY", at, "")]
    if spec.get("metric") not in domains:
        out.append(("CONFIG_CATEGORICAL_DOMAIN_UNKNOWN", at, str(spec.get("metric"))))
    else:
        missing, extra = domain_gaps(list(domains[spec["metric"]]), list(mapped))
        out += [("CONFIG_CATEGORICAL_INCOMPLETE", at, str(missing))] if missing else []
        out += [("CONFIG_CATEGORICAL_EXTRA", at, str(extra))] if extra else []
    return out + _scores([(f"map.{k}", v) for k, v in mapped.items()], f"{at}.rule", most, "CONFIG_BAND_SCORE")


def findings(policy: Mapping[str, Any], known: Sequence[str] | None = None, domains: Mapping[str, Sequence[str]] | None = None, total: float | None = None) -> list[Finding]:
    """All faults of a policy; none means that it can score.

    known: metrics that there are (the registry's, unless told). domains: the
    categories of categorical ones. total: what the modules' maxima add up to.
    """
    known, domains = list(metrics.REGISTRY) if known is None else known, metrics.DOMAINS if domains is None else domains
    modules = policy.get("modules") or []
    out: list[Finding] = [] if modules else [("CONFIG_NO_MODULES", "modules", "")]
    seen: set[str] = set()
    for module in modules:
        at = f"modules.{module.get('id')}"
        for spec in module.get("criteria", []):
            where = f"{at}.{spec.get('id')}"
            if spec.get("id") in seen:
                out.append(("CONFIG_DUPLICATE_CRITERION", where, str(spec.get("id"))))
            seen.add(spec.get("id"))
            out += _criterion(spec, where, known, domains)
            unknown = set(spec.get("exclude_in_modes", [])) - {"preliminary", "final"}
            out += [("CONFIG_MODE_EXCLUDE_UNKNOWN", where, str(sorted(unknown)))] if unknown else []
        held = sum(float(c.get("max") or 0) for c in module.get("criteria", []) if c.get("kind") != "penalty")
        if "max" in module and abs(held - float(module["max"])) > 1e-9:
            out.append(("CONFIG_MODULE_MAX_MISMATCH", at, f"{held} <> {module['max']}"))
    if total is not None and modules and abs(sum(float(c.get("max") or 0) for m in modules for c in m.get("criteria", []) if c.get("kind") != "penalty") - total) > 1e-9:
        out.append(("CONFIG_TOTAL_MISMATCH", "modules", str(total)))
    for i, knockout in enumerate(policy.get("knockouts", [])):
        at = f"knockouts.{knockout.get('id', i)}"
        out += expression(knockout["when"], at, known) if "when" in knockout else [("CONFIG_KNOCKOUT_NO_WHEN", at, "")]
        out += [] if knockout.get("required") else [("CONFIG_KNOCKOUT_NO_REQUIRED", at, "")]
    for i, item in enumerate(policy.get("penalties", {}).get("items", [])):
        out += expression(item["when"], f"penalties[{i}]", known) if "when" in item or "scale" in item and "when" in item else ([] if "scale" in item else [("CONFIG_PENALTY_NO_WHEN", f"penalties[{i}]", "")])
    for i, cap in enumerate(policy.get("caps", [])):
        out += expression(cap.get("when"), f"caps[{i}]", known)
    out += [("CONFIG_CRITICAL_DATA_UNKNOWN", "critical_data", m) for m in policy.get("critical_data", {}).get("items", []) if m not in known]
    spec = policy.get("verdict")
    if spec is not None:
        least = [b.get("min") for b in spec.get("bands", [])]
        out += [] if least else [("CONFIG_VERDICT_NO_BANDS", "verdict", "")]
        out += [] if "else" in spec else [("CONFIG_VERDICT_NO_ELSE", "verdict", "")]
        out += [("CONFIG_VERDICT_BANDS_UNORDERED", "verdict", str(least))] if least != sorted(least, reverse=True) else []
    ids = {c.get("id") for m in modules for c in m.get("criteria", [])}
    for kind in ("sector_overlays", "structure_overlays"):
        for name, overlay in (policy.get(kind) or {}).items():
            at = f"{kind}.{name}"
            out += [("CONFIG_OVERLAY_REMOVE_UNKNOWN", at, c) for c in overlay.get("remove", []) if c not in ids]
            out += [("CONFIG_METRIC_OVERRIDE_UNKNOWN_CRITERION", at, c) for c in overlay.get("override", {}) if c not in ids]
            out += [("CONFIG_OVERLAY_UNKNOWN_MODULE", at, m) for m in overlay.get("add", {}) if m not in {x.get("id") for x in modules}]
            added = [c for cs in overlay.get("add", {}).values() for c in cs]
            out += [("CONFIG_OVERLAY_ADD_EXISTING", at, c["id"]) for c in added if c.get("id") in ids - set(overlay.get("remove", []))]
            for c in added:
                out += _criterion(c, f"{at}.{c.get('id')}", known, domains)
            if "when" in overlay:
                out += expression(overlay["when"], at, known)
            if total is not None and modules:
                made = sum(m["max"] for m in overlaid(policy, [overlay])["modules"])
                out += [("CONFIG_OVERLAY_TOTAL", at, f"{made} <> {total}")] if abs(made - total) > 1e-9 else []
    return out
