"""Let texts pass, or not: identifiers first, then the safety filter's answer.

Only narrow rows travel: the text stays on the scan side and the answer is judged
before the join. A text without a usable answer is denied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.config import PolicyOptions, ScanOptions
from idcordon.functions.sql import choose, lit, name
from idcordon.functions.text import is_blank
from idcordon.operators.policy import evaluate_policy
from idcordon.operators.report import text_report

NO_ANSWER = "No usable answer of the safety filter."


def policy_verdicts(
    responses: DataFrame, key: str, options: PolicyOptions = PolicyOptions(), keep: list[str] = ()
) -> DataFrame:
    """Verdicts under names that do not clash with those of a report."""
    return evaluate_policy(responses, options).selectExpr(
        name(key),
        *[name(c) for c in keep],
        "is_allowed AS p_allowed",
        "decision AS p_decision",
        "reason AS p_reason",
        "risk_score AS p_risk",
        "violations AS p_violations",
        "concat(rbi_codes, sebi_codes) AS p_codes",
    )


def _with_verdicts(left: DataFrame, verdicts: DataFrame, key: str, needed: str) -> DataFrame:
    """Left join of the answers; a missing one counts as a failed call."""
    # The test stands in the join condition: nulling the key of rows that need no
    # answer would send all of them to one partition.
    a = left.selectExpr(*[name(c) for c in left.columns], f"{needed} AS _needed").alias("a")
    # Rows made of parsed JSON are taken for far smaller than they are, and all of them would be broadcast.
    v = verdicts.withColumnRenamed(key, "_answer_key").alias("v").hint("merge")
    joined = a.join(v, F.expr(f"a.{name(key)} = v._answer_key AND a._needed"), "left")
    return _closed(joined, [name(c) for c in left.columns])


def _with_answers(left: DataFrame, responses: DataFrame, key: str, needed: str, options: PolicyOptions) -> DataFrame:
    """As ``_with_verdicts``, but an answer is judged after the join, so only if its text needs it."""
    # Numbered, so that no name clashes with those of a verdict.
    own = {c: f"_own_{i}" for i, c in enumerate(left.columns)}
    a = left.selectExpr(*[f"{name(c)} AS {o}" for c, o in own.items()], f"{needed} AS _needed")
    r = responses.selectExpr(f"{name(key)} AS _answer_key", "success", "response", "error_message").hint("merge")
    joined = a.join(r, F.expr(f"{own[key]} = _answer_key AND _needed"), "left")
    judged = policy_verdicts(joined, "_answer_key", options, keep=[*own.values(), "_needed"])
    return _closed(judged, [f"{o} AS {name(c)}" for c, o in own.items()])


def _closed(joined: DataFrame, columns: list[str]) -> DataFrame:
    missing = "_needed AND _answer_key IS NULL"
    closed = {
        "p_allowed": "false",
        "p_decision": "'deny'",
        "p_reason": lit(
            f"Safety gate denied: Fail-Closed Security Gate: {NO_ANSWER}. "
            "Controls: RBI-ITG-SEC-01, SEBI-CSCRF-AI-01. Risk score: 1.0."
        ),
        "p_risk": "1.0D",
        "p_violations": f"array({lit(f'Fail-Closed Security Gate: {NO_ANSWER}')})",
        "p_codes": "array('RBI-ITG-SEC-01', 'SEBI-CSCRF-AI-01')",
    }
    return joined.selectExpr(
        *columns,
        "_needed",
        f"{missing} AS answer_missing",
        *[f"if({missing}, {value}, {column}) AS {column}" for column, value in closed.items()],
    )


def gate(
    texts: DataFrame,
    key: str,
    text_col: str = "text",
    responses: DataFrame | None = None,
    stages: tuple[str, ...] = ("identifiers", "policy"),
    keep: list[str] = (),
    ask: bool = False,
    turn_blocked: str | None = None,
    skip: str | None = None,
    scan: ScanOptions = ScanOptions(),
    policy: PolicyOptions = PolicyOptions(),
    judge_needed: bool = False,
) -> DataFrame:
    """Verdict, stage, reason and risk of every text.

    ``responses`` holds at most one answer per ``key``: success, response, error_message.
    With ``ask`` a ``force_ask`` decision stays; otherwise it denies, as for prompts.
    ``turn_blocked`` names a boolean column: true denies before anything is read.
    ``skip`` (SQL over the columns): such texts are let through unread. ``answer_missing``
    tells where an answer was needed and none came. With ``judge_needed`` answers are joined as they are and judged
    only where a text needs them: for streams, whose every micro-batch meets the whole table of answers.
    """
    text = name(text_col)
    early = name(turn_blocked) if turn_blocked else "false"
    columns = list(dict.fromkeys([key, *keep, *([turn_blocked] if turn_blocked else [])]))
    unread = " OR ".join(["false", *([f"coalesce({early}, false)"] if turn_blocked else []), *([f"coalesce({skip}, false)"] if skip else [])])
    texts = texts.selectExpr(*[name(c) for c in columns], f"if({unread}, NULL, {text}) AS {text}")
    if "identifiers" in stages:
        reports = text_report(texts.select(*columns, text_col), text_col, scan)
        hit = "blocked_by_policy"
    else:
        reports = texts.selectExpr(
            *[name(c) for c in columns], text,
            "NULL AS violation_summary", "0.0D AS pii_risk_score",
            "cast(NULL AS array<struct<start:int,end:int,ord:int,rank:int,masked:string>>) AS spans",
        )
        hit = "false"
    first = reports.selectExpr(
        *[name(c) for c in columns],
        f"{early} AS _early",
        f"{is_blank(text)} AS _blank",
        f"{hit} AS _hit",
        "violation_summary",
        "pii_risk_score",
        # Only denied texts need their spans later, for the audit trail.
        f"if({hit}, spans, NULL) AS spans",
    )
    needed = "NOT _early AND NOT _blank AND NOT _hit"
    if "policy" in stages:
        if responses is None:
            raise ValueError("the policy stage needs responses")
        if judge_needed:
            both = _with_answers(first, responses, key, needed, policy)
        else:
            both = _with_verdicts(first, policy_verdicts(responses, key, policy), key, needed)
    else:
        both = first.selectExpr(
            "*", "false AS _needed", "false AS answer_missing", "true AS p_allowed", "'allow' AS p_decision",
            "'' AS p_reason", "0.0D AS p_risk",
            "cast(NULL AS array<string>) AS p_violations", "cast(NULL AS array<string>) AS p_codes",
        )
    denied = "_needed AND NOT p_allowed"
    return both.selectExpr(
        *[name(c) for c in columns],
        choose(
            ("_early", "'deny'"), ("_blank", "'allow'"), ("_hit", "'deny'"),
            (denied, "p_decision" if ask else "'deny'"), otherwise="'allow'",
        )
        + " AS verdict",
        choose(
            ("_early", "'turn'"), ("_blank", "'skipped'"), ("_hit", "'identifiers'"),
            (denied, "'policy'"), otherwise="'passed'",
        )
        + " AS stage",
        choose(
            ("_early", "'Turn is blocked by an earlier denial.'"),
            ("_blank", "'No text to scan.'"),
            ("_hit", "violation_summary"),
            (denied, "p_reason"),
            otherwise="'All stages passed.'",
        )
        + " AS reason",
        choose(
            ("_early OR _blank", "0.0D"), ("_hit", "pii_risk_score"), (denied, "p_risk"),
            otherwise="0.0D",
        )
        + " AS risk_score",
        f"if({denied}, p_decision, NULL) AS policy_decision",
        "if(_early, NULL, spans) AS spans",
        f"if({denied}, p_violations, NULL) AS policy_violations",
        f"if({denied}, p_codes, NULL) AS policy_codes",
        "answer_missing",
    )


def overall_verdict(
    texts: DataFrame,
    responses: DataFrame,
    key: str,
    text_col: str = "text",
    scan: ScanOptions = ScanOptions(),
    policy: PolicyOptions = PolicyOptions(),
) -> DataFrame:
    """Both stages for every text, whatever the first one says; allowed when both agree."""
    reports = text_report(texts.select(key, text_col), text_col, scan).select(
        key, "blocked_by_policy", "total_matches", "highest_severity"
    )
    both = _with_verdicts(reports, policy_verdicts(responses, key, policy), key, "true")
    return both.selectExpr(
        name(key), "blocked_by_policy", "total_matches", "highest_severity",
        "p_allowed AS policy_allowed", "p_decision AS policy_decision", "p_risk AS policy_risk",
        "NOT blocked_by_policy AND p_allowed AS is_allowed",
    )
