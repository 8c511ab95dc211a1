from __future__ import annotations

import json

from pyspark.sql import functions as F

from idcordon.config import PolicyOptions
from idcordon.operators.extract import (
    conversation_key, event_type, extract_text, latest_user_prompt, skip_empty,
)
from idcordon.operators.gate import gate, overall_verdict
from idcordon.operators.policy import evaluate_policy
from idcordon.sources.records import (
    parse_events, parse_responses, read_audit, read_transcripts,
)


def events(spark, payloads):
    rows = [(i, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
    return parse_events(spark.createDataFrame(rows, "event_id bigint, payload string"))


def test_extract_text_order(spark):
    args = {"Query": "q", "CommandLine": "ls", "Prompt": "", "other": 1}
    cases = [
        ({"toolCall": {"name": "run", "args": args}}, ("ls\nq", "tool_args:run")),
        ({"toolCall": {"name": "t", "args": {"z": "é ₹", "b": 2, "a": True, "f": 1.5, "n": None, "d": {"x": 1}}}},
         ("é ₹ 2 True 1.5", "tool_args_all:t")),
        ({"toolCall": {"args": {"k": 12345678.5}}}, ("12345678.5", "tool_args_all:None")),
        ({"toolCall": {"name": "t", "args": {}}, "prompt": "p"}, ("p", "payload:prompt")),
        ({"transcriptPath": "/t/1", "prompt": "p"}, ("from transcript", "transcript:user_input")),
        ({"transcriptPath": "/t/2", "prompt": "p"}, ("p", "payload:prompt")),
        ({"content": 42, "userMessage": "m"}, ("42", "payload:content")),
        ({"userPrompt": None, "content": "c"}, ("None", "payload:userPrompt")),
        ({"stepIdx": 1}, ("", "empty")),
        ("{broken", ("", "empty")),
    ]
    prompts = spark.createDataFrame([("/t/1", "from transcript")], "transcript_path string, latest_prompt string")
    found = extract_text(events(spark, [c[0] for c in cases]), prompts)
    got = {r.event_id: (r.scan_text, r.text_source) for r in found.collect()}
    for i, (_, expected) in enumerate(cases):
        assert got[i] == expected
    skipped = {r.event_id for r in skip_empty(found).where("skipped").collect()}
    assert skipped == {8, 9}


def test_event_fields_types_and_keys(spark):
    df = events(spark, [
        {"conversationId": "a b/c-1_é", "toolCall": None}, {"invocationNum": 1},
        {"invocationNum": 1, "stepIdx": None}, {"invocationNum": 1, "transcriptPath": "/x"}, "oops", {"conversationId": "!!"},
    ])
    kinds = [r.event_type for r in event_type(df).orderBy("event_id").collect()]
    assert kinds == ["pre_tool_use", "post_invocation", "pre_invocation", "pre_invocation", "pre_invocation", "pre_invocation"]
    keys = [r.k for r in df.orderBy("event_id").selectExpr(f"{conversation_key('conversation_id')} AS k").collect()]
    assert keys == ["abc-1_é", "default", "default", "default", "default", "default"]
    flagged = event_type(df.withColumn("flag", F.lit(" Post_Invocation ")), "flag")
    assert {r.event_type for r in flagged.collect()} == {"post_invocation"}


def test_transcript_files(spark, tmp_path):
    one = [
        {"type": "USER_INPUT", "content": "first"}, "", "{bad", {"type": "MODEL", "content": "reply"},
        {"source": "USER_EXPLICIT", "content": "second"}, {"type": "USER_INPUT", "content": ""}, ["not", "an", "object"],
    ]
    lines = [x if isinstance(x, str) else json.dumps(x) for x in one]
    (tmp_path / "one.jsonl").write_text("\n".join(lines * 400 + [json.dumps({"type": "USER_INPUT", "content": "last"})]))
    (tmp_path / "two.jsonl").write_text(json.dumps({"type": "MODEL", "content": "only"}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = latest_user_prompt(read_transcripts(spark, str(tmp_path)), "file").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.file.rsplit("/", 1)[1], r.latest_prompt) for r in got] == [("one.jsonl", "last")]


def test_audit_lines_keep_unreadable_records(spark, tmp_path):
    (tmp_path / "trail.log").write_text('{"event_id":"a","risk_score":0.9}\n\nnot json\n{"event_id":"b"}\n')
    rows = read_audit(spark, str(tmp_path), line_order=True).orderBy("line_no").collect()
    assert [(r.event_id, r.readable) for r in rows] == [("a", True), (None, False), ("b", True)]


def answer(state="NO_MATCH_FOUND", invoked="SUCCESS", **filters):
    return json.dumps({"sanitizationResult": {
        "filterMatchState": state, "invocationResult": invoked, "filterResults": filters}})


def judge(spark, *responses, options=PolicyOptions()):
    rows = [(i, *(r if isinstance(r, tuple) else (True, r, None))) for i, r in enumerate(responses)]
    df = spark.createDataFrame(rows, "k bigint, success boolean, response string, error_message string")
    return evaluate_policy(df, options).orderBy("k").collect()


def test_policy_cases(spark):
    injection = {"piAndJailbreakFilterResult": {"matchState": "MATCH_FOUND", "confidenceLevel": "HIGH", "score": 0.95}}
    low = {"pi_and_jailbreak_filter_result": {"match_state": "MATCH_FOUND", "confidence_level": "CONFIDENCE_LEVEL_UNSPECIFIED"}}
    empty_camel = {"piAndJailbreakFilterResult": {}, "pi_and_jailbreak_filter_result": {"match_state": "MATCH_FOUND"}}
    rows = judge(
        spark, answer(), answer("MATCH_FOUND", pi_and_jailbreak=injection), (False, None, "no route"),
        answer(invoked="FAILURE"), "{bad", None, answer(pi_and_jailbreak=low), answer("MATCH_FOUND", pi_and_jailbreak=low),
        answer(pi_and_jailbreak=empty_camel), "{}",
    )
    assert [r.decision for r in rows] == ["allow", "deny", "deny", "deny", "deny", "deny", "allow", "deny", "deny", "allow"]
    assert rows[1].violations == ["Prompt Injection / Jailbreak Attack Detected (Confidence: HIGH, Score: 0.95)"]
    assert (rows[1].risk_score, rows[1].rbi_codes, rows[1].sebi_codes) == (0.95, ["RBI-ITG-SEC-02"], ["SEBI-CSCRF-AI-01"])
    assert rows[2].violations == ["Fail-Closed Security Gate: no route"] and rows[2].risk_score == 1.0
    assert rows[7].violations == ["Safety Filter Triggered (MATCH_FOUND)"]
    assert rows[8].violations == ["Prompt Injection / Jailbreak Attack Detected (Confidence: HIGH, Score: 0.95)"]


def test_policy_actions(spark):
    hit = answer("MATCH_FOUND")
    ask = judge(spark, hit, (False, None, None), options=PolicyOptions(action_on_match="force_ask"))
    assert [(r.decision, r.is_allowed) for r in ask] == [("force_ask", False), ("deny", False)]
    warn = judge(spark, hit, options=PolicyOptions(action_on_match="WARN"))
    assert warn[0].is_allowed and warn[0].violations


def test_response_defaults(spark):
    df = spark.createDataFrame([('{"sanitization_result": {"filter_match_state": "MATCH_FOUND"}}',), ("{}",), ("x",)], "response string")
    got = [(r.filter_match_state, r.invocation_result) for r in parse_responses(df).collect()]
    assert got == [("MATCH_FOUND", "SUCCESS"), ("NO_MATCH_FOUND", "SUCCESS"), (None, None)]


def test_gates(spark):
    texts = spark.createDataFrame(
        [(1, "hello", False), (2, "PAN ABCPE1234F", False), (3, "  ", False), (4, "no answer", False),
         (5, "bad answer", False), (6, "hello", True), (7, "PIN code 400001", False)],
        "k bigint, text string, held boolean",
    )
    clean, hit = answer(), answer("MATCH_FOUND")
    responses = spark.createDataFrame(
        [(1, True, clean, None), (2, True, clean, None), (5, True, hit, None), (6, True, clean, None), (7, True, clean, None)],
        "k bigint, success boolean, response string, error_message string",
    )
    got = {r.k: (r.verdict, r.stage) for r in gate(texts, "k", "text", responses, turn_blocked="held").collect()}
    assert got == {
        1: ("allow", "passed"), 2: ("deny", "identifiers"), 3: ("allow", "skipped"), 4: ("deny", "policy"),
        5: ("deny", "policy"), 6: ("deny", "turn"), 7: ("allow", "passed"),
    }
    asked = gate(texts, "k", "text", responses, ask=True, policy=PolicyOptions(action_on_match="FORCE_ASK"))
    assert {r.k: r.verdict for r in asked.collect()}[5] == "force_ask"
    both = {r.k: r.is_allowed for r in overall_verdict(texts, responses, "k").collect()}
    assert both == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True}
