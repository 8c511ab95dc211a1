"""Judge answers of the safety filter, one verdict per text, all inside the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.config import PolicyOptions
from idcordon.functions.levels import CONFIDENCE_RANK, confidence_at_least
from idcordon.functions.sql import choose, let, lit, name
from idcordon.functions.text import py_float
from idcordon.sources.records import parse_responses

# Risk, control codes and wording of each rule. Risks and codes are fixed values, and so are the
# words the control mapping looks for; the sentences around them are our own.
RBI_DATA, RBI_AI = "RBI-ITG-SEC-01", "RBI-ITG-SEC-02"
DPDP = "DPDP-2023-SEC-08"
SEBI_AI, SEBI_NET = "SEBI-CSCRF-AI-01", "SEBI-CSCRF-NET-03"
RULES = {
    # rule: (risk, first-regulator codes, second-regulator codes)
    "fail_closed": (1.0, (RBI_DATA,), (SEBI_AI,)),
    "injection": (0.95, (RBI_AI,), (SEBI_AI,)),
    "responsible_ai": (0.85, (RBI_AI,), (SEBI_AI,)),
    "sensitive_data": (0.90, (RBI_DATA, DPDP), (SEBI_AI,)),
    "malicious_uri": (0.95, (RBI_AI,), (SEBI_NET,)),
    "csam": (1.0, (RBI_DATA,), (SEBI_AI,)),
    "fallback": (0.90, (RBI_AI,), (SEBI_AI,)),
}
FAILED_CALL = "Safety filter call failed."
WORDING = {
    "fail_closed": "Fail-Closed Security Gate: ",
    "injection": "Prompt Injection / Jailbreak Attack Detected (Confidence: %s, Score: %s)",
    "responsible_ai": "Responsible AI Safety Breach: %s (Confidence: %s)",
    "sensitive_data": "Sensitive Data Protection Breach: Detected ",
    "malicious_uri": "Malicious / Phishing URI Detected: ",
    "csam": "CSAM Content Policy Violation Detected",
    "fallback": "Safety Filter Triggered (MATCH_FOUND)",
}


def _state(s: str) -> str:
    return f"coalesce(nullif({s}.matchState, ''), {s}.match_state)"


def _confidence(s: str, absent: str) -> str:
    return f"coalesce(nullif({s}.confidenceLevel, ''), {s}.confidence_level, {lit(absent)})"


def _at_least(confidence: str, unknown: str, threshold: str) -> str:
    known = ", ".join(lit(n) for n in CONFIDENCE_RANK)
    level = f"if({confidence} IN ({known}), {confidence}, {lit(unknown)})"
    return confidence_at_least(level, lit(threshold))


# Keys of each part of an answer; a part none of whose keys is there counts as empty.
_STATE_KEYS = ("matchState", "match_state")
_KEYS = {
    "piAndJailbreakFilterResult": (*_STATE_KEYS, "confidenceLevel", "confidence_level", "score"),
    "raiFilterResult": (*_STATE_KEYS, "raiFilterTypeResults", "rai_filter_type_results"),
    "sdpFilterResult": ("inspectResult", "inspect_result"),
    "maliciousUriFilterResult": (*_STATE_KEYS, "matchedUris", "matched_uris"),
    "csamFilterFilterResult": _STATE_KEYS,
    "inspectResult": (*_STATE_KEYS, "findings"),
}


def _either(wrapper: str, camel: str, snake: str) -> str:
    """The camel-case result unless it is absent or empty."""
    c = f"{wrapper}.{camel}"
    return f"if({' OR '.join(f'{c}.{k} IS NOT NULL' for k in _KEYS[camel])}, {c}, {wrapper}.{snake})"


def with_rules(df: DataFrame, options: PolicyOptions = PolicyOptions()) -> DataFrame:
    """Add one array of violations per rule to rows of ``success``, ``response``, ``error_message``."""
    keep = [name(c) for c in df.columns]
    read = parse_responses(df)
    base = [*keep, "filter_match_state", "invocation_result"]
    unusable = "NOT coalesce(success, false) OR coalesce(invocation_result, 'FAILURE') = 'FAILURE'"
    opened = read.selectExpr(
        *base,
        f"({unusable}) AS failed",
        _either("filters.pi_and_jailbreak", "piAndJailbreakFilterResult",
                "pi_and_jailbreak_filter_result") + " AS _inj",
        _either("filters.rai", "raiFilterResult", "rai_filter_result") + " AS _rai",
        _either("filters.sdp", "sdpFilterResult", "sdp_filter_result") + " AS _sdp",
        _either("filters.malicious_uris", "maliciousUriFilterResult",
                "malicious_uri_filter_result") + " AS _uri",
        _either("filters.csam", "csamFilterFilterResult", "csam_filter_filter_result") + " AS _csam",
    ).selectExpr(
        "*", _either("_sdp", "inspectResult", "inspect_result") + " AS _inspect"
    )

    def rule(test: str, violation: str) -> str:
        return f"if(NOT failed AND coalesce({test}, false), array({violation}), cast(array() AS array<string>))"

    injected = _confidence("_inj", "HIGH")
    score = choose(
        ("_inj.score IS NULL", "'0.95'"),
        (r"rlike(_inj.score, r'[.eE]')", let("try_cast(_inj.score AS double)", "d", py_float("d"))),
        otherwise="_inj.score",
    )
    types = (
        "if(coalesce(size(_rai.raiFilterTypeResults), 0) > 0, _rai.raiFilterTypeResults, "
        "_rai.rai_filter_type_results)"
    )
    category = _confidence("e.value", "LOW")
    category_hit = (
        f"coalesce({_state('e.value')}, 'MATCH_FOUND') = 'MATCH_FOUND' AND "
        f"{_at_least(category, 'LOW', options.responsible_ai_threshold)}"
    )
    breaches = (
        f"transform(filter(map_entries({types}), e -> {category_hit}), e -> "
        f"format_string({lit(WORDING['responsible_ai'])}, e.key, {category}))"
    )
    found_types = (
        "array_distinct(filter(transform(_inspect.findings, f -> "
        "coalesce(nullif(f.infoType, ''), f.info_type)), t -> coalesce(t, '') <> ''))"
    )
    uris = (
        "if(coalesce(size(_uri.matchedUris), 0) > 0, _uri.matchedUris, _uri.matched_uris)"
    )
    named = "if(coalesce(size({0}), 0) > 0, array_join({0}, ', '), {1})".format
    return (
        opened.selectExpr(
            *base,
            "failed",
            "if(failed, array(concat("
            f"{lit(WORDING['fail_closed'])}, coalesce(nullif(error_message, ''), {lit(FAILED_CALL)}))), "
            "cast(array() AS array<string>)) AS fail_closed",
            rule(
                f"{_state('_inj')} = 'MATCH_FOUND' AND "
                f"{_at_least(injected, 'HIGH', options.injection_threshold)}",
                f"format_string({lit(WORDING['injection'])}, {injected}, {score})",
            )
            + " AS injection",
            "coalesce(try_cast(_inj.score AS double), 0.95D) AS injection_score",
            f"if(NOT failed AND coalesce({_state('_rai')} = 'MATCH_FOUND', false), "
            f"coalesce({breaches}, array()), array()) AS responsible_ai",
            rule(
                f"{_state('_inspect')} = 'MATCH_FOUND'",
                f"concat({lit(WORDING['sensitive_data'])}, {named(found_types, lit('FSI Regulatory PII'))})",
            )
            + " AS sensitive_data",
            rule(
                f"{_state('_uri')} = 'MATCH_FOUND'",
                f"concat({lit(WORDING['malicious_uri'])}, {named(uris, lit('Unsafe URL'))})",
            )
            + " AS malicious_uri",
            rule(f"{_state('_csam')} = 'MATCH_FOUND'", lit(WORDING["csam"])) + " AS csam",
        )
        .selectExpr(
            "*",
            rule(
                "filter_match_state = 'MATCH_FOUND' AND size(injection) + size(responsible_ai) + "
                "size(sensitive_data) + size(malicious_uri) + size(csam) = 0",
                lit(WORDING["fallback"]),
            )
            + " AS fallback",
        )
    )


def evaluate_policy(df: DataFrame, options: PolicyOptions = PolicyOptions()) -> DataFrame:
    """One verdict per row: is_allowed, decision, reason, risk_score, violations and codes."""
    rules = with_rules(df, options)
    order = list(RULES)

    def codes(which: int) -> str:
        lists = ", ".join(
            f"if(size({r}) > 0, array({', '.join(lit(c) for c in RULES[r][which])}), "
            "cast(array() AS array<string>))"
            for r in order
        )
        return f"array_sort(array_distinct(concat({lists})))"

    risks = ", ".join(
        f"if(size({r}) > 0, {'injection_score' if r == 'injection' else lit(RULES[r][0])}, 0.0D)"
        for r in order
    )
    decision = {"BLOCK": "deny", "FORCE_ASK": "force_ask"}.get(options.action_on_match.upper(), "allow")
    matched = "NOT failed AND filter_match_state = 'MATCH_FOUND'"
    flagged = f"(size(violations) > 0 OR ({matched}))"
    reason = (
        "concat('Safety gate denied: ', array_join(violations, '; '), '. Controls: ', "
        "array_join(array_sort(array_distinct(concat(rbi_codes, sebi_codes))), ', '), "
        f"'. Risk score: ', {py_float('risk_score')}, '.')"
    )
    return (
        rules.selectExpr(
            *[name(c) for c in df.columns],
            "failed",
            "filter_match_state",
            f"concat({', '.join(order)}) AS violations",
            f"{codes(1)} AS rbi_codes",
            f"{codes(2)} AS sebi_codes",
            f"round(greatest({risks}), 2) AS risk_score",
        )
        .selectExpr(
            *[name(c) for c in df.columns],
            choose(
                ("failed", "'deny'"), (flagged, lit(decision)), otherwise="'allow'"
            )
            + " AS decision",
            "risk_score",
            "violations",
            "rbi_codes",
            "sebi_codes",
            choose(
                (f"failed OR {flagged}", reason),
                otherwise="'Safety gate passed: nothing found.'",
            )
            + " AS reason",
        )
        .select("*", (F.col("decision") == "allow").alias("is_allowed"))
    )
