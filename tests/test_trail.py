from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from idcordon.config import GENESIS
from idcordon.functions.canonical import event_hash
from idcordon.operators.audit import (
    audit_tail, chain_events, chain_links, last_hashes, retained, verify_hashes, verify_links,
)
from idcordon.operators.controls import (
    control_coverage, control_lookup, controls_frame, map_controls_rbi, map_controls_sebi,
)
from idcordon.operators.turns import turn_blocks
from idcordon.sources.shared import shared_dir, stored
from idcordon.sources.sinks import append_audit, route_regulated
from idcordon.streaming.tables import drain, parquet_stream
from idcordon.streaming.turns import stream_turn_blocks
from tests.plain import record_hash

SALT = 'sälz"'
SCHEMA = (
    "chain_id string, seq bigint, event_id string, timestamp_utc string, conversation_id string, step_idx bigint, "
    "hook_name string, decision string, risk_score double, detected_violations array<string>, event_date date"
)
ODD = ['quote " and \\', "tab\t nl\n cr\r", "é ₹ 😀", "\x00\x07\x08\x0c\x1f\x7f", ""]


def trail_rows(n: int, seed: int = 1):
    """A third of all records sit in one chain; sequence numbers have holes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        chain = "hot" if rng.random() < 0.34 else f"c{rng.randrange(9)}"
        rows.append((
            chain, i * 3, f"E{i}", f"2024-01-01T00:00:{i % 60:02d}+00:00", chain, rng.choice([None, i]), "hook é",
            rng.choice(["deny", "force_ask"]), rng.choice([0.0, 0.7, 0.85, 1.0]), rng.sample(ODD, rng.randrange(4)),
            datetime(2024, 1, 1).date() + timedelta(days=i % 400),
        ))
    return rows


def expected_links(rows):
    last, out = {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        event = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r))
        link = last.get(r[0], GENESIS)
        last[r[0]] = record_hash(event, link, SALT)
        out[(r[0], r[1])] = (link, last[r[0]])
    return out


def as_links(df):
    return {(r.chain_id, r.seq): (r.prev_event_hash, r.event_hash) for r in df.collect()}


def test_hash_is_that_of_python_json(spark):
    rows = trail_rows(200)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("prev_event_hash", F.lit("abc"))
    names = df.columns
    for r in df.select(*names, F.expr(event_hash(SALT)).alias("h")).collect():
        assert r.h == record_hash(r.asDict(), "abc", SALT)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_chains(spark, batch):
    rows = trail_rows(600)
    df = stored(spark.createDataFrame(rows, SCHEMA), "rows")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = as_links(chain_links(df, SALT))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected_links(rows)


def test_a_null_chain_keeps_its_rows(spark):
    rows = trail_rows(90)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("chain_id", F.when(F.col("chain_id") != "hot", F.col("chain_id")))
    good = stored(chain_events(df, SALT), "null-chain")
    assert good.count() == 90
    assert good.where("prev_event_hash = event_hash").count() == 0
    assert verify_links(good).where("broken").count() == 0
    assert verify_links(good.where("seq <> 30")).count() == 89


def test_resumed_chain_is_the_same(spark):
    rows = trail_rows(300)
    df = spark.createDataFrame(rows, SCHEMA)
    first = chain_links(df.where("seq < 450"), SALT)
    second = chain_links(df.where("seq >= 450"), SALT, resume=last_hashes(first))
    assert {**as_links(first), **as_links(second)} == expected_links(rows)


def test_verification_finds_each_harm(spark):
    rows = trail_rows(400)
    good = stored(chain_events(spark.createDataFrame(rows, SCHEMA), SALT), "good")
    assert verify_links(good, stretch=60).where("broken").count() == 0
    assert verify_hashes(good, SALT).where("altered").count() == 0
    hot = [r[1] for r in sorted(rows, key=lambda r: r[1]) if r[0] == "hot"]
    taken, relinked, rewritten = hot[10], hot[30], hot[50]
    bad = good.where(f"seq <> {taken}").withColumn(
        "prev_event_hash", F.when(F.col("seq") == relinked, "x").otherwise(F.col("prev_event_hash"))
    ).withColumn("decision", F.when(F.col("seq") == rewritten, "allow").otherwise(F.col("decision")))
    for stretch in (7, 60, 100_000):
        broken = {r.seq for r in verify_links(bad, stretch=stretch).where("broken").collect()}
        assert broken == {hot[11], relinked}
    altered = {r.seq for r in verify_hashes(bad, SALT).where("altered").collect()}
    assert altered == {relinked, rewritten}


def test_unreadable_record_is_broken_and_skipped(spark):
    rows = [("c", 1, True, "g", "h1"), ("c", 2, False, None, None), ("c", 3, True, "h1", "h3"), ("d", 5, True, "z", "y")]
    df = spark.createDataFrame(rows, "chain_id string, seq bigint, readable boolean, prev_event_hash string, event_hash string")
    assert {r.seq: r.broken for r in verify_links(df).collect()} == {1: False, 2: True, 3: False, 5: False}


def test_append_tail_and_retention(spark):
    path = shared_dir(spark, "appended")
    df = spark.createDataFrame(trail_rows(100), SCHEMA)
    append_audit(df.where("seq < 150"), path)
    append_audit(df.where("seq >= 150"), path)
    back = spark.read.parquet(path)
    assert back.count() == 100
    assert [r.seq for r in audit_tail(back, ["seq"], 3).collect()] == [297, 294, 291]
    kept = retained(back, "DATE '2024-02-01'", days=10)
    assert kept.count() == back.where("event_date >= '2024-01-22'").count() > 0
    assert "PartitionFilters: [isnotnull(event_date" in kept._jdf.queryExecution().executedPlan().toString()


def turn_rows(n: int, seed: int):
    rng = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for i in range(n):
        kind = rng.choice(["prompt", "tool", "tool", "post"])
        conversation = "hot" if rng.random() < 0.4 else f"c{rng.randrange(5)}"
        start += timedelta(seconds=rng.choice([0, 1, 20, 149, 150, 299, 300, 301]) / 2)
        rows.append((conversation, start, i, kind, kind == "prompt" and rng.random() < 0.6))
    return rows


TURNS = "conversation_id string, ts timestamp, event_id bigint, kind string, denied boolean"


def simulated(rows):
    since, out = {}, {}
    for conversation, ts, event_id, kind, denied in rows:
        at = since.get(conversation)
        blocked = kind != "prompt" and at is not None and (ts - at).total_seconds() < 300
        out[event_id] = (blocked, blocked and kind == "post")
        if kind == "prompt" and denied:
            since[conversation] = ts
        elif kind in ("prompt", "post"):
            since.pop(conversation, None)
    return out


@pytest.mark.parametrize("stretch", ["HOUR", "MINUTE", "DAY"])
def test_turn_blocks_in_batch(spark, stretch):
    rows = turn_rows(2000, 3)
    got = turn_blocks(spark.createDataFrame(rows, TURNS), stretch=stretch).collect()
    assert {r.event_id: (r.blocked, r.terminate) for r in got} == simulated(rows)


def test_turn_blocks_as_a_stream(spark):
    rows = turn_rows(600, 4)
    source, out, checkpoint = (shared_dir(spark, p) for p in ("in", "out", "cp"))
    schema = spark.createDataFrame([], TURNS).schema
    for a, b in ((0, 200), (200, 201), (201, 600)):
        spark.createDataFrame(rows[a:b], TURNS).coalesce(1).write.mode("append").parquet(source)
        drain(stream_turn_blocks(parquet_stream(spark, source, schema)), out, checkpoint)
    got = spark.read.parquet(out).collect()
    assert len(got) == 600
    assert {r.event_id: (r.blocked, r.terminate) for r in got} == simulated(rows)


def test_controls(spark):
    df = spark.createDataFrame(
        [(["Aadhaar (XXXX)", "Card CVV"],), (["Prompt Injection seen", "PAN (AB)"],), (["SECURITY of a COMPANY"],), ([],)],
        "v array<string>",
    )
    got = df.selectExpr(f"{map_controls_rbi('v')} AS r", f"{map_controls_sebi('v')} AS s").collect()
    assert [r.r for r in got] == [["RBI-DPSC-03", "RBI-ITG-SEC-01"], ["RBI-ITG-SEC-01", "RBI-ITG-SEC-02"], ["RBI-ITG-SEC-01"], []]
    assert [r.s for r in got] == [[], ["SEBI-CSCRF-AI-01", "SEBI-CSCRF-DP-02"], ["SEBI-CSCRF-DP-02", "SEBI-CSCRF-NET-03"], []]
    assert controls_frame(spark, "DPDP").count() == 0 and controls_frame(spark).count() == 8
    with pytest.raises(ValueError):
        controls_frame(spark, "OTHER")
    looked = control_lookup(spark.createDataFrame([("RBI-DPSC-03",), ("?",)], "control_id string")).collect()
    assert {r.control_id: r.title for r in looked} == {"RBI-DPSC-03": "Card Data Security & Non-Storage", "?": None}


def test_coverage_and_routing(spark):
    from idcordon.operators.detect import scan_spans, with_hits
    from idcordon.operators.resolve import with_spans

    texts = spark.createDataFrame([(1, "PAN ABCPE1234F CVV: 123 PIN code 400001")], "id int, text string")
    covered = {r.control_id: r.n_spans for r in control_coverage(with_spans(with_hits(texts))).collect()}
    assert len(covered) == 8
    assert (covered["RBI-ITG-SEC-01"], covered["RBI-DPSC-03"], covered["SEBI-CSCRF-DP-02"]) == (2, 1, 1)
    routed = route_regulated(scan_spans(texts, ["id"])).collect()
    assert {r.entity_type for r in routed} == {"PAN"}
