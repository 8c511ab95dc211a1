"""The streaming guard on busy conversations and large tables of answers."""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from idcordon.operators.gate import gate
from idcordon.plans.guard import guard_events, stream_guard_events
from idcordon.sources.records import parse_responses
from idcordon.sources.shared import shared_dir
from idcordon.streaming.tables import drain, parquet_stream
from idcordon.streaming.turns import stream_turn_blocks

TURNS = "conversation_id string, ts timestamp, event_id bigint, kind string, denied boolean"
START = datetime(2024, 1, 1)


def drained(spark, parts, schema, job):
    """What ``job`` gives for parts that arrive one after the other."""
    source, out, checkpoint = (shared_dir(spark, p) for p in ("in", "out", "checkpoint"))
    for rows in parts:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(source)
        drain(job(parquet_stream(spark, source, frame.schema)), out, checkpoint)
    return spark.read.parquet(out)


def walked(parts):
    """The rule row by row: each part in order of time and id, the flag handed on from part to part."""
    since, out = {}, {}
    for rows in parts:
        for conversation, ts, event_id, kind, denied in sorted(rows, key=lambda r: (r[1] is None, r[1] or START, r[2])):
            at = since.get(conversation)
            out[event_id] = kind != "prompt" and None not in (at, ts) and (ts - at).total_seconds() < 300
            if kind == "prompt":
                since[conversation] = ts if denied else None
            elif kind == "post":
                since[conversation] = None
    return out


def turns(n, seed, kinds=("prompt", "tool", "tool", "post"), steps=(0, 1, 149, 299, 300, 2000)):
    rng, at = random.Random(seed), START
    for i in range(n):
        at += timedelta(seconds=rng.choice(steps) / 2)
        kind = rng.choice(kinds)
        yield rng.choice(["hot", "hot", "hot", "cold", None]), at, i, kind, kind == "prompt" and rng.random() < 0.6


def test_parts_in_order_and_late_ones_are_answered_in_order_of_arrival(spark):
    rows = list(turns(900, 1))
    rows = [(c, None if i % 37 == 0 else t, i, k, d) for c, t, i, k, d in rows]
    for parts in ([rows[:300], rows[300:301], rows[301:]], [rows[::3], rows[1::3], rows[2::3]]):
        got = drained(spark, parts, TURNS, stream_turn_blocks).collect()
        assert len(got) == 900
        assert {r.event_id: r.blocked for r in got} == walked(parts)
        assert all(r.terminate == (r.blocked and r.kind == "post") for r in got)


def test_a_conversation_of_tools_only_keeps_the_flag_over_hours(spark):
    first = [("c", START, 0, "prompt", True)]
    late = [("c", START + timedelta(seconds=s), 1 + n, "tool", False) for n, s in enumerate([1, 299, 300, 3600, 7200, -4000])]
    got = drained(spark, [first, late], TURNS, stream_turn_blocks).collect()
    assert {r.event_id for r in got if r.blocked} == {1, 2, 6}


def test_a_busy_conversation_is_many_tasks(spark):
    """The state's task sees the ends of hours only; before, it saw and answered every row."""
    rows = [("hot", t, i, k, d) for _, t, i, k, d in turns(20000, 2, steps=(4, 8))]
    job = lambda stream: stream_turn_blocks(stream).withColumn("task", F.spark_partition_id())
    got = drained(spark, [rows], TURNS, job).collect()
    assert {r.event_id: r.blocked for r in got} == walked([rows])
    sizes = Counter(r.task for r in got)
    assert len(sizes) == 4 and max(sizes.values()) < 15000


def test_answers_are_read_only_where_a_text_needs_them(spark):
    match = '{"sanitizationResult":{"filterMatchState":"MATCH_FOUND","invocationResult":"SUCCESS","filterResults":{}}}'
    clean = match.replace("MATCH_FOUND", "NO_MATCH_FOUND")
    texts = spark.createDataFrame(
        [(1, "fine", "x"), (2, "PAN ABCPE1234F", "y"), (3, " ", "z"), (4, "no answer", None), (None, "no key", "k"), (6, "twice", "t"), (7, "failed", "f")],
        "id bigint, text string, reason string",
    )
    answers = spark.createDataFrame(
        [(1, True, match, None), (2, True, match, None), (3, True, match, None), (6, True, clean, None), (6, True, clean, None), (7, False, None, "timeout")],
        "id bigint, success boolean, response string, error_message string",
    )
    plain, late = (gate(texts, "id", "text", answers, keep=["reason"], ask=True, judge_needed=x) for x in (False, True))
    assert late.columns == plain.columns
    keyed = lambda df: sorted(map(str, df.drop("spans").collect()))
    assert keyed(late) == keyed(plain) and len(keyed(late)) == 8
    below = [re.split("Join", g._jdf.queryExecution().optimizedPlan().toString(), maxsplit=1)[1] for g in (plain, late)]
    assert ["from_json" in x for x in below] == [True, False]


PAYLOADS = "event_id bigint, ts timestamp, payload string"


def payloads(n):
    for i in range(n):
        said = ["ask", "card 4532015112830366", "ok"][i % 3]
        body = f'"stepIdx":{i},"content":"{said}"' if i % 4 else f'"toolCall":{{"name":"run","args":{{"Query":"find {i}"}}}}'
        yield i, START + timedelta(seconds=40 * i), f'{{"conversationId":"c{i % 2}",{body}}}'


@pytest.mark.parametrize("columns", [None, ("conversation",)])
def test_the_stream_gives_the_verdicts_of_the_batch(spark, columns):
    rows = list(payloads(120))
    clean = '{"sanitizationResult":{"filterMatchState":"NO_MATCH_FOUND"}}'
    answers = [(i, i % 7 != 0, clean if i % 5 else '["no object"]', None) for i in range(120) if i % 11]
    answers = spark.createDataFrame(answers, "event_id bigint, success boolean, response string, error_message string")
    job = lambda stream: stream_guard_events(stream, None, answers, columns=columns)
    got = drained(spark, [rows[:50], rows[50:]], PAYLOADS, job)
    whole = guard_events(spark.createDataFrame(rows, PAYLOADS), None, answers)
    if columns is not None:
        assert set(got.columns) == {"event_id", "conversation", "verdict", "stage", "reason", "risk_score", "terminate"}
    kept = ["event_id", "conversation", "verdict", "stage", "reason", "risk_score", "terminate"]
    assert sorted(map(str, got.select(kept).collect())) == sorted(map(str, whole.select(kept).collect()))
    assert {r.stage for r in got.collect()} == {"identifiers", "policy", "passed", "turn"}


def test_only_objects_are_answers(spark):
    texts = [" {}", "\t\r\n{}", "[]", " [{}]", '"{}"', "{} {}", "", None, "null"]
    got = parse_responses(spark.createDataFrame(list(enumerate(texts)), "k int, response string")).orderBy("k").collect()
    assert [r.k for r in got if r.filter_match_state == "NO_MATCH_FOUND"] == [0, 1]
