"""Streams in order with busy keys: how rows wait, and how a busy conversation is dealt."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from idcordon.operators.turns import turn_blocks
from idcordon.sources.shared import shared_dir
from idcordon.streaming.ordered import InOrder
from idcordon.streaming.tables import drain, parquet_stream, rocks
from idcordon.streaming.turns import ordered_turn_blocks


class Store:
    """State of one key, as the handle gives it; counts elements and reads."""

    def __init__(self):
        self.rows, self.value, self.reads, self.timers = [], None, 0, []

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        store = self

        class Value:
            def exists(self):
                return store.value is not None

            def get(self):
                return store.value

            def update(self, value):
                store.value = value

            def clear(self):
                store.value = None

        return Value()

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return bool(self.rows)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def clear(self):
        self.rows = []


class Clock:
    def __init__(self, passed):
        self.passed = passed

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_rows_wait_in_chunks_and_are_read_when_due():
    rows = [(i * 1000, json.dumps([i, 0]), json.dumps({"i": i})) for i in range(5000)]
    random.Random(1).shuffle(rows)
    chunks = [pd.DataFrame(rows[i : i + 2500], columns=["at", "place", "record"]) for i in (0, 2500)]
    store, job = Store(), InOrder(lambda last, e: (e["i"], {"last": last}), lambda last, e: {"late": True})
    job.init(store)
    assert not list(job.handleInputRows(("k",), iter(chunks), Clock(0)))
    assert len(store.rows) <= 6 and store.reads == 0 and store.timers == [1]
    early = pd.concat(job.handleExpiredTimer(("k",), Clock(3000), None))
    assert [json.loads(r)["i"] for r in early["record"]] == list(range(3000))
    assert len(store.rows) == 2
    rest = pd.concat(job.handleExpiredTimer(("k",), Clock(9000), None))
    assert [json.loads(g)["last"] for g in rest["given"]] == list(range(2999, 4999)) and not store.rows
    late = pd.concat(job.handleInputRows(("k",), iter([chunks[0][:3]]), Clock(9000)))
    assert [json.loads(g) for g in late["given"]] == [{"late": True}] * 3 and not store.rows


def test_busy_conversation_is_folded_in_stretches(spark):
    """Flags hold beyond the end of a stretch, and one conversation is several groups."""
    start, rng = datetime(2024, 1, 1, 0, 0, 0), random.Random(5)
    times = [h * 3600 + s for h in (1, 2, 3) for s in range(-330, 330, 6)]
    rows = [("one", start + timedelta(seconds=t), i, rng.choice(["prompt", "tool", "tool", "post"]), rng.random() < 0.8) for i, t in enumerate(times)]
    rows += [("~end", start + timedelta(days=9), -1, "tool", False)]
    schema = "conversation_id string, ts timestamp, event_id bigint, kind string, denied boolean"
    events = spark.createDataFrame(rows, schema)
    source, out, checkpoint = (shared_dir(spark, x) for x in ("in", "out", "checkpoint"))
    with rocks(spark):
        for own in (events.where("conversation_id = 'one'"), events.where("conversation_id <> 'one'")):
            own.write.mode("append").parquet(source)
            job = ordered_turn_blocks(parquet_stream(spark, source, events.schema), "1 day")
            drain(job, out, checkpoint)
    assert "stretch" in job._jdf.queryExecution().logical().toString()
    want = turn_blocks(events).where("event_id >= 0").select("event_id", "blocked", "terminate")
    got = spark.read.parquet(out).where("event_id >= 0").select("event_id", "blocked", "terminate")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    crossing = want.where(F.col("blocked")).join(events, "event_id").where("minute(ts) < 5").count()
    assert crossing > 0
