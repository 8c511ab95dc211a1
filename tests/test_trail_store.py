"""The stored trail: exactly-once appends, disorder, digests, removal; and streams in order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from idcordon.config import GENESIS
from idcordon.operators.audit import chain_events, last_hashes, verify_hashes, verify_links
from idcordon.operators.digest import digest_tree, harmed_stretches
from idcordon.sources.shared import shared_dir, stored
from idcordon.sources.trail import append_once, append_stream, chain_ends, drop_expired, read_trail, write_batch
from idcordon.streaming.audit import stream_chain, stream_verify
from idcordon.streaming.tables import drain, parquet_stream, rocks
from idcordon.streaming.turns import ordered_turn_blocks
from tests.plain import record_hash

SALT = 'sälz"'
SCHEMA = (
    "chain_id string, seq bigint, event_id string, timestamp_utc string, conversation_id string, step_idx bigint, "
    "hook_name string, decision string, risk_score double, detected_violations array<string>, event_date date, ts timestamp"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
START = datetime(2024, 1, 1)


def rows_of(n, seed=1):
    """A third in one chain, a null chain, null and shared places, null fields."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        chain = "hot" if rng.random() < 0.34 else rng.choice([None, "a", "b"])
        seq = None if rng.random() < 0.05 else i // 3
        violations = rng.choice([None, [], ["x", None], ['q"\t₹']])
        rows.append((chain, seq, f"E{i:04d}", f"t{i}", rng.choice([None, "c"]), rng.choice([None, i]), "h", rng.choice([None, "deny"]),
                     rng.choice([None, 0.5, 1.0]), violations, START.date() + timedelta(days=i % 5), START + timedelta(seconds=i)))
    return rows


def expected(rows):
    """(chain, seq, event id) to links; the first of a repeated place is linked."""
    last, out = {}, {}
    for r in sorted(set((r[0], r[1], r[2]) for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        event = dict(zip(NAMES, next(x for x in rows if x[:3] == r)))
        link = last.get(r[0], GENESIS)
        last[r[0]] = record_hash(event, link, SALT)
        out[r] = (link, last[r[0]])
    return out


def linked(df):
    return {(r.chain_id, r.seq, r.event_id): (r.prev_event_hash, r.event_hash) for r in df.where("event_hash IS NOT NULL").collect()}


def test_null_places_repeats_and_null_fields(spark):
    rows = rows_of(300)
    df = spark.createDataFrame(rows + rows[40:60], SCHEMA)
    chained = stored(chain_events(df, SALT), "chained")
    assert chained.count() == 320 and chained.columns == [*NAMES, "prev_event_hash", "event_hash"]
    assert linked(chained) == expected(rows)
    unlinked = chained.where("event_hash IS NULL")
    assert unlinked.where("prev_event_hash IS NOT NULL").count() == 0
    assert unlinked.count() == sum(r[1] is None for r in rows) + 20
    assert verify_hashes(chained, SALT).where("altered").count() == 0
    assert verify_links(chained, stretch=7).where("broken").count() == 0


def test_a_record_that_lost_its_hashes_is_found(spark):
    rows = [r for r in rows_of(120) if r[0] == "hot" and r[1] is not None]
    good = chain_events(spark.createDataFrame(rows, SCHEMA), SALT)
    lost = F.col("event_id") == sorted(rows, key=lambda r: (r[1], r[2]))[5][2]
    bad = good.withColumns({c: F.when(~lost, F.col(c)) for c in ("prev_event_hash", "event_hash")})
    after = sorted(rows, key=lambda r: (r[1], r[2]))[6][2]
    assert {r.event_id for r in verify_links(stored(bad, "bad")).where("broken").collect()} == {after}


def test_appends_are_exact(spark):
    rows = rows_of(200)
    df = stored(spark.createDataFrame(rows, SCHEMA), "rows")
    path = shared_dir(spark, "trail")
    with pytest.raises(ValueError):
        read_trail(spark, path)
    assert append_once(df.where("ts < '2024-01-01 00:01:00'"), path, "a", SALT)
    assert not append_once(df, path, "a", SALT)  # that name is done
    assert append_once(df.where("false"), path, "none", SALT)
    write_batch(df.where("ts < '2024-01-01 00:02:00'"), path, "b", SALT)  # broken off
    assert read_trail(spark, path).count() == 60
    assert append_once(df.where("ts < '2024-01-01 00:01:40'"), path, "b", SALT)
    assert append_once(df, path, "c", SALT)
    assert append_once(df, path, "d", SALT)
    back = stored(read_trail(spark, path), "back")
    assert back.count() == 200 and linked(back) == expected(rows)
    assert verify_links(back).where("broken").count() == 0
    ends = {r.chain_id: r.last_hash for r in chain_ends(spark, path).collect()}
    assert ends == {r.chain_id: r.last_hash for r in last_hashes(back).collect()}


def test_an_event_behind_its_chain_is_kept_apart(spark):
    rows = [r for r in rows_of(90) if r[1] is not None]
    late, others = rows[10], rows[:10] + rows[11:]
    path = shared_dir(spark, "trail")
    append_once(spark.createDataFrame(others, SCHEMA), path, "1", SALT)
    for name in "23":
        append_once(spark.createDataFrame([late], SCHEMA), path, name, SALT)
    back = read_trail(spark, path)
    assert [(r.prev_event_hash, r.event_hash) for r in back.where(F.col("event_id") == late[2]).collect()] == [(None, None)]
    assert linked(back) == expected(others)


def test_batch_names_are_safe(spark):
    with pytest.raises(ValueError):
        write_batch(spark.createDataFrame([], SCHEMA), shared_dir(spark, "trail"), "../x", SALT)


def test_stream_appends_once(spark):
    rows = rows_of(90)
    source, path, checkpoint = (shared_dir(spark, x) for x in ("in", "trail", "checkpoint"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        append_stream(parquet_stream(spark, source, schema), path, SALT, checkpoint)
    assert linked(read_trail(spark, path)) == expected(rows)


def test_expired_days_go_and_chains_go_on(spark):
    rows = rows_of(100)
    df = spark.createDataFrame(rows, SCHEMA)
    path = shared_dir(spark, "trail")
    append_once(df.where("seq < 20"), path, "1", SALT)
    assert drop_expired(spark, path, "2024-01-08", days=4) == 3
    assert drop_expired(spark, path, "2024-01-08", days=4) == 0
    left = read_trail(spark, path)
    assert {str(r.event_date) for r in left.collect()} == {"2024-01-04", "2024-01-05"}
    append_once(df.where("seq >= 20"), path, "2", SALT)
    want = expected(rows)
    assert all(want[k] == h for k, h in linked(read_trail(spark, path)).items())


@pytest.mark.parametrize("stretch,fan,levels", [(10, 3, 2), (1, 2, 4), (1000, 16, 1)])
def test_harmed_stretches(spark, stretch, fan, levels):
    rows = rows_of(250)
    good = stored(chain_events(spark.createDataFrame(rows, SCHEMA), SALT), "good")
    before = digest_tree(good, SALT, stretch, fan, levels)
    assert harmed_stretches(before, digest_tree(good, SALT, stretch, fan, levels), fan, levels).count() == 0
    changed, gone, relinked = (f"E{i:04d}" for i in [i for i, r in enumerate(rows) if r[1] is not None][40:160:50])
    bad = good.where(F.col("event_id") != gone).withColumns({
        "decision": F.when(F.col("event_id") == changed, "allow").otherwise(F.col("decision")),
        "event_hash": F.when(F.col("event_id") == relinked, "x").otherwise(F.col("event_hash")),
    })
    got = {(r.chain_id, r.node) for r in harmed_stretches(before, digest_tree(bad, SALT, stretch, fan, levels), fan, levels).collect()}
    assert got == {(r[0], r[1] // stretch) for r in rows if r[2] in (changed, gone, relinked)}


def arrive(spark, rows, schema, job, jitter, parts=3, seed=1, end=()):
    rng = random.Random(seed)
    at = schema.split(", ").index("ts timestamp")
    rows = sorted(rows, key=lambda r: r[at] + timedelta(seconds=rng.uniform(0, jitter)))
    source, out, checkpoint = (shared_dir(spark, x) for x in ("in", "out", "checkpoint"))
    kind = spark.createDataFrame([], schema).schema
    size = -(-len(rows) // parts)
    with rocks(spark):
        for part in [*(rows[i : i + size] for i in range(0, len(rows), size)), *([e] for e in end)]:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            drain(job(parquet_stream(spark, source, kind)), out, checkpoint)
    return spark.read.parquet(out)


def last_row(seconds=86_400, chain="~end", seq=1, event_id="~"):
    return (chain, seq, event_id, "t", "c", None, "h", "deny", 0.0, [], START.date(), START + timedelta(seconds=seconds))


def test_stream_in_disorder_is_the_batch(spark):
    rows = rows_of(120) + rows_of(120)[30:35]
    late = last_row(1, "hot", 0, "LATE")
    got = arrive(spark, rows, SCHEMA, lambda s: stream_chain(s, SALT, "30 seconds"), 25, end=[last_row(), late])
    got = stored(got.where("chain_id IS NULL OR chain_id <> '~end'"), "streamed")
    assert got.count() == 126
    assert linked(got) == expected(rows)
    assert got.where("event_id = 'LATE'").first().event_hash is None  # its place was passed
    assert verify_hashes(got, SALT).where("altered").count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_stream_verification_finds_the_harm(spark):
    rows = [r for r in rows_of(120) if r[1] is not None]
    good = chain_events(spark.createDataFrame(rows, SCHEMA), SALT)
    ids = [r[2] for r in sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1], r[2]))]
    schema = "chain_id string, seq bigint, event_id string, ts timestamp, prev_event_hash string, event_hash string"
    bad = [tuple("x" if c == "prev_event_hash" and r.event_id == ids[20] else r[c] for c in ("chain_id", "seq", "event_id", "ts", "prev_event_hash", "event_hash"))
           for r in good.collect() if r.event_id != ids[10]]
    end = ("~end", 1, "~", START + timedelta(days=1), None, None)
    got = arrive(spark, bad, schema, lambda s: stream_verify(s, "30 seconds"), 25, end=[end])
    assert {r.event_id for r in got.where("broken").collect()} == {ids[11], ids[20]}
    assert got.count() == len(bad)


def test_turns_in_three_orders(spark):
    rng = random.Random(2)
    rows, at = [], START
    for i in range(90):
        at += timedelta(seconds=rng.choice([0, 1, 149, 299, 300, 301]))
        kind = rng.choice(["prompt", "tool", "post", "tool"])
        rows.append((rng.choice(["hot", "hot", "c", None]), at, i, kind, kind == "prompt" and rng.random() < 0.6))
    since, want = {}, {}
    for c, t, i, kind, denied in rows:
        blocked = kind != "prompt" and c in since and t - since[c] < timedelta(seconds=300)
        want[i] = (blocked, blocked and kind == "post")
        if kind != "tool":
            since.pop(c, None)
        if denied:
            since[c] = t
    schema = "conversation_id string, ts timestamp, event_id bigint, kind string, denied boolean"
    end = [("~end", START + timedelta(days=30), -1, "tool", False)]
    for seed in (1, 2):
        got = arrive(spark, rows, schema, lambda s: ordered_turn_blocks(s, "2000 seconds"), 1900, parts=seed, seed=seed, end=end)
        assert {r.event_id: (r.blocked, r.terminate) for r in got.collect() if r.event_id >= 0} == want
