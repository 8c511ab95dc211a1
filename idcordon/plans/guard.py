"""Whole jobs, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.config import PolicyOptions, ScanOptions
from idcordon.functions.sql import name
from idcordon.operators.audit import audit_events, chain_events
from idcordon.operators.extract import conversation_key, event_type, extract_text, latest_user_prompt
from idcordon.operators.gate import gate
from idcordon.operators.redact import apply_action_mode
from idcordon.operators.report import text_report
from idcordon.operators.turns import turn_blocks
from idcordon.sources.records import parse_events
from idcordon.sources.shared import stored
from idcordon.streaming.turns import stream_turn_blocks


def scan_table(
    df: DataFrame, key: str, text_col: str = "text", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """A report and the outgoing text for each row of a table; one stage, no shuffle."""
    reports = text_report(df.select(key, text_col), text_col, options)
    return apply_action_mode(reports, text_col, options).drop("spans", text_col)


def card_documents(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts that hold a valid payment card number, redacted."""
    others = tuple(e.key for e in ScanOptions().catalog if e.key != "CREDIT_DEBIT_CARD")
    reports = text_report(df.select(key, text_col), text_col, ScanOptions(allowed=others))
    return reports.where("contains_pii").select(
        key, "total_matches", "highest_severity", "blocked_by_policy", "redacted_text"
    )


def guard_events(
    payloads: DataFrame,
    transcripts: DataFrame | None,
    responses: DataFrame,
    ts: str = "ts",
    scan: ScanOptions = ScanOptions(),
    policy: PolicyOptions = PolicyOptions(),
) -> DataFrame:
    """Verdict of every JSON event: prompts, tool calls and after-events.

    ``payloads``: event_id, ts, payload. ``transcripts``: transcript_path and the parsed
    lines. ``responses``: event_id, success, response, error_message. Texts are scanned
    once; the turn rule then runs over narrow verdict rows.
    """
    prompts = None if transcripts is None else latest_user_prompt(transcripts, "transcript_path")
    marked = _judged(payloads, prompts, responses, ts, scan, policy)
    # The turn rule reads its input twice; the texts are scanned only once.
    flagged = turn_blocks(stored(marked, "verdicts"), "conversation", ts, "event_id")
    return _settled(flagged, [c for c in marked.columns if c not in ("kind", "denied")])


def stream_guard_events(
    payloads: DataFrame,
    prompts: DataFrame | None,
    responses: DataFrame,
    ts: str = "ts",
    scan: ScanOptions = ScanOptions(),
    policy: PolicyOptions = PolicyOptions(),
    lateness: str | None = None,
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """``guard_events`` over a stream of ``payloads``, with the same verdicts.

    ``prompts`` (transcript_path, latest_prompt) and ``responses`` are tables. Parsing, scan and
    gates keep no state; turns keep the last denial of a conversation (see ``stream_turn_blocks``).
    Every micro-batch reads both whole, so store what is dear to make; only answers that its texts need are judged.
    ``columns`` names those to keep besides the event, its verdict, stage, reason and risk; all by default.
    """
    marked = _judged(payloads, prompts, responses, ts, scan, policy, judge_needed=True)
    kept = [c for c in marked.columns if c not in ("kind", "denied", "event_id")]
    if columns is not None:
        kept = [c for c in kept if c in (*columns, "verdict", "stage", "reason", "risk_score")]
    events = marked.selectExpr("*", "conversation AS conversation_id", f"{name(ts)} AS _at")
    events = events.withColumnRenamed(ts, "_ts").withColumnRenamed("_at", "ts") if ts != "ts" else events.drop("_at")
    carried = ["_ts" if c == ts and ts != "ts" else c for c in kept]
    flagged = stream_turn_blocks(events, lateness=lateness, carry=tuple(carried)).drop("conversation_id")
    return _settled(flagged.withColumnRenamed("_ts", ts), ["event_id", *kept])


def _judged(
    payloads: DataFrame, prompts: DataFrame | None, responses: DataFrame, ts: str, scan: ScanOptions, policy: PolicyOptions,
    judge_needed: bool = False,
) -> DataFrame:
    """Verdicts of both stages with ``kind`` and ``denied``, before the turn rule."""
    parsed = event_type(parse_events(payloads)).withColumn(
        "conversation", F.expr(conversation_key("conversation_id"))
    )
    judged = gate(
        extract_text(parsed, prompts), "event_id", "scan_text", responses,
        keep=["conversation", ts, "event_type", "step_idx", "tool_name", "text_source"],
        ask=True, skip="event_type = 'post_invocation'", scan=scan, policy=policy, judge_needed=judge_needed,
    )
    kinds = {"pre_tool_use": "tool", "post_invocation": "post", "pre_invocation": "prompt"}
    kind = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in kinds.items()) + " END"
    return judged.selectExpr(
        "*", f"{kind} AS kind", "event_type = 'pre_invocation' AND verdict <> 'allow' AS denied"
    )


def _settled(flagged: DataFrame, columns: list[str]) -> DataFrame:
    """Final verdicts: a blocked turn denies a tool call, an after-event is let through."""
    held = "kind = 'tool' AND blocked"
    return flagged.selectExpr(
        *[name(c) for c in columns if c not in ("verdict", "stage", "reason", "risk_score")],
        f"CASE WHEN {held} THEN 'deny' WHEN kind = 'post' THEN 'allow' "
        "WHEN kind = 'prompt' AND verdict <> 'allow' THEN 'deny' ELSE verdict END AS verdict",
        f"CASE WHEN {held} THEN 'turn' WHEN kind = 'post' THEN 'skipped' ELSE stage END AS stage",
        f"CASE WHEN {held} THEN 'Turn is blocked by an earlier denial.' "
        "WHEN kind = 'post' THEN 'No text to scan.' ELSE reason END AS reason",
        f"CASE WHEN {held} OR kind = 'post' THEN 0.0D ELSE risk_score END AS risk_score",
        "terminate",
    )


def guard_and_audit(
    payloads: DataFrame, transcripts: DataFrame | None, responses: DataFrame, salt: str, ts: str = "ts"
) -> DataFrame:
    """Audit records of all denied events, chained by conversation in order of event id."""
    verdicts = guard_events(payloads, transcripts, responses, ts)
    events = audit_events(
        verdicts, "conversation", "event_id", ts, "guard",
        event_type="if(event_type = 'pre_tool_use', 'PRE_TOOL_USE', 'PRE_INVOCATION')",
        metadata="map('source', text_source, 'tool_name', coalesce(tool_name, ''), 'stage', stage)",
        step_idx="step_idx",
    )
    return chain_events(events, salt)
