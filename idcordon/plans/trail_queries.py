"""Registered queries of the stored trail: exactly-once appends, disorder, digests, streams in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idcordon.operators import audit as audit_ops
from idcordon.operators.digest import digest_tree, harmed_stretches
from idcordon.plans import oracle as o
from idcordon.plans import views as v
from idcordon.plans.registry import audit_records, harmed, register, _HARM
from idcordon.sources import trail as trails
from idcordon.sources.shared import shared_dir, stored
from idcordon.streaming.audit import stream_chain, stream_verify
from idcordon.streaming.tables import drain, parquet_stream, rocks
from idcordon.streaming.turns import ordered_turn_blocks

_LINKS = ("chain_id", "seq", "event_id", "prev_event_hash", "event_hash")


def parts_of(df: DataFrame, order: str, shares: list[float]) -> list[DataFrame]:
    """The rows cut by quantiles of ``order``."""
    cuts = df.agg(F.percentile_approx(order, shares)).first()[0] or []
    place = " + ".join(f"CAST({order} > {c} AS INT)" for c in cuts) or "0"
    return [df.where(f"{place} = {i}") for i in range(len(cuts) + 1)]


@register("append_once", f"{o.chained()} SELECT l.chain_id, l.seq, event_id, prev_event_hash, event_hash FROM links l JOIN au USING (seq)")
def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch appended twice, one that breaks off before it counts, and one that holds all of both and the rest."""
    events = stored(audit_records(spark, sf_dir), "events")
    early, middle, late = parts_of(events, "seq", [0.4, 0.7])
    path = shared_dir(spark, "trail")
    trails.append_once(early, path, "1", o.SALT)
    trails.append_once(early, path, "1", o.SALT)
    trails.append_once(early.where("seq % 2 = 0"), path, "again", o.SALT)
    trails.write_batch(middle.unionByName(late), path, "2", o.SALT)  # not committed
    trails.append_once(middle, path, "2", o.SALT)
    trails.append_once(events, path, "3", o.SALT)
    return trails.read_trail(spark, path).select(*_LINKS)


# --- null and repeated places, null fields ----------------------------------------

_ODD = (
    "chain_id", "CASE WHEN seq % 37 = 4 THEN NULL ELSE seq - seq % 6 END AS seq", "ts", "event_id", "conversation_id", "step_idx", "hook_name",
    "CASE WHEN seq % 11 <> 2 THEN decision END AS decision", "CASE WHEN seq % 7 <> 3 THEN risk END AS risk",
    "CASE WHEN seq % 5 <> 1 THEN violation END AS violation", "kind", "seq % 41 = 3 AS repeats", "seq % 13 = 5 AS unlisted",
)


def odd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events of which some have no seq, share a place, come twice, or lack fields."""
    view = v.AUDIT.frame(spark, sf_dir).selectExpr(*_ODD)
    view = view.unionByName(view.where("repeats"))
    clock = audit_ops.utc_clock(view, "ts")
    return view.selectExpr(
        "chain_id", "seq", "event_id", "conversation_id", "cast(step_idx AS bigint) AS step_idx", "hook_name", "decision",
        "cast(risk AS double) AS risk_score", "if(unlisted, NULL, array(violation)) AS detected_violations",
        f"{audit_ops.iso_utc(clock)} AS timestamp_utc", f"to_date({clock}) AS event_date", "cast(ts AS timestamp) AS ts",
    )


def _odd_links() -> str:
    """CTEs up to ``result``: each event with its hashes; of repeats and events without a seq only the nulls."""
    quoted = "coalesce('\"' || {0} || '\"', 'null')".format
    return f"""WITH RECURSIVE base AS (SELECT {', '.join(_ODD)} FROM ({v.AUDIT.sql()})),
    given AS (SELECT *, 1 AS copy FROM base UNION ALL SELECT *, 2 FROM base WHERE repeats),
    au AS (SELECT *, {o.ISO} AS stamp, '{{"conversation_id": ' || {quoted('conversation_id')} || ', "decision": ' || {quoted('decision')} || ', "detected_violations": ' ||
        CASE WHEN unlisted THEN 'null' ELSE '[' || {quoted(o._escaped('violation'))} || ']' END || ', "event_id": ' || {quoted('event_id')} || ', "hook_name": ' ||
        {quoted('hook_name')} || ', "prev_event_hash": "' AS head,
        '", "risk_score": ' || coalesce(CAST(CAST(risk AS DOUBLE) AS STRING), 'null') || ', "salt": "{o.SALT}", "step_idx": ' || coalesce(CAST(step_idx AS STRING), 'null')
        || ', "timestamp_utc": "' || stamp || '"}}' AS tail FROM given),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY seq, event_id) AS n FROM au WHERE seq IS NOT NULL AND copy = 1),
    links AS (
        SELECT chain_id, seq, event_id, n, '{o.GENESIS}' AS prev_event_hash, sha256(head || '{o.GENESIS}' || tail) AS event_hash FROM numbered WHERE n = 1
        UNION ALL
        SELECT x.chain_id, x.seq, x.event_id, x.n, l.event_hash, sha256(x.head || l.event_hash || x.tail)
        FROM links l JOIN numbered x ON x.chain_id IS NOT DISTINCT FROM l.chain_id AND x.n = l.n + 1),
    result AS (SELECT chain_id, seq, event_id, prev_event_hash, event_hash FROM links
        UNION ALL SELECT chain_id, seq, event_id, NULL, NULL FROM au WHERE seq IS NULL OR copy = 2)"""


@register("chain_odd_events", f"{_odd_links()} SELECT *, false AS altered, false AS broken FROM result")
def chain_odd_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained, stored and verified: no event is lost, and no untouched record is called altered or broken."""
    chained = stored(audit_ops.chain_events(odd_records(spark, sf_dir), o.SALT), "odd-trail")
    checked = audit_ops.verify_hashes(audit_ops.verify_links(chained), o.SALT)
    return checked.select(*_LINKS, "altered", "broken")


@register("append_odd_events", f"{_odd_links()} SELECT * FROM result EXCEPT SELECT * FROM result WHERE event_hash IS NULL AND seq IS NOT NULL")
def append_odd_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events in two overlapping batches; of an event that comes twice one is stored."""
    events = stored(odd_records(spark, sf_dir), "odd")
    early, _ = parts_of(events, "seq", [0.5])
    path = shared_dir(spark, "odd-trail")
    trails.append_once(early, path, "1", o.SALT)
    trails.append_once(events, path, "2", o.SALT)
    return trails.read_trail(spark, path).select(*_LINKS)


# --- digests ----------------------------------------------------------------------

_STRETCH, _FAN, _LEVELS = 40, 4, 2


@register("harmed_stretches", f"""WITH {o.audit()}
    SELECT chain_id, CAST(seq // {_STRETCH} AS BIGINT) AS node, count(*) AS n_before, count(*) FILTER (WHERE NOT ({_HARM[2]})) AS n_after FROM au
    GROUP BY 1, 2 HAVING bool_or({') OR bool_or('.join(_HARM)})""")
def harmed_stretches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = stored(audit_ops.chain_events(audit_records(spark, sf_dir), o.SALT), "trail")
    before = digest_tree(trail, o.SALT, _STRETCH, _FAN, _LEVELS)
    after = digest_tree(harmed(trail), o.SALT, _STRETCH, _FAN, _LEVELS)
    return harmed_stretches(before, after, _FAN, _LEVELS)


def _levels() -> str:
    whole = "string_agg(digest, '' ORDER BY node)"
    return ", ".join(
        f"level{i} AS (SELECT chain_id, {i} AS level, CAST(node // {_FAN} AS BIGINT) AS node, sha256({whole}) AS digest, CAST(sum(n) AS BIGINT) AS n "
        f"FROM level{i - 1} GROUP BY chain_id, node // {_FAN})"
        for i in range(1, _LEVELS + 1)
    )


@register("digest_tree", f"""{o.chained()},
    level0 AS (SELECT chain_id, 0 AS level, CAST(seq // {_STRETCH} AS BIGINT) AS node, sha256(string_agg(event_hash || event_hash, '' ORDER BY seq)) AS digest, count(*) AS n
      FROM links GROUP BY chain_id, seq // {_STRETCH}), {_levels()}
    {' UNION ALL '.join(f'SELECT * FROM level{i}' for i in range(_LEVELS + 1))}""")
def digest_tree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = stored(audit_ops.chain_events(audit_records(spark, sf_dir), o.SALT), "trail")
    return digest_tree(trail, o.SALT, _STRETCH, _FAN, _LEVELS)


# --- streams that arrive out of order ---------------------------------------------

_LATENESS = 3600


def shuffled(
    frame: DataFrame, key: str, job: Callable[[DataFrame], DataFrame], ts: str = "ts", seed: int = 1, parts: int = 3
) -> DataFrame:
    """What a job gives for rows that arrive in ``parts``, each up to ``_LATENESS`` seconds out of order.

    A row that is a day younger than all comes last, under a key of its own, so that the watermark passes them.
    """
    spark = frame.sparkSession
    source, out, checkpoint = (shared_dir(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    frame = frame.withColumn(ts, F.col(ts).cast("timestamp"))
    jitter = F.pmod(F.xxhash64(*frame.columns, F.lit(seed)), F.lit(_LATENESS - 1))
    coming = stored(frame.withColumn("_comes", F.unix_timestamp(ts) + jitter), "coming")
    end = frame.agg(F.max(ts).alias(ts)).select(
        *[(F.col(ts) + F.expr("INTERVAL 1 DAY") if c == ts else F.lit("~end") if c == key else F.lit(None)).cast(t).alias(c) for c, t in frame.dtypes]
    )
    with rocks(spark):
        for rows in [*parts_of(coming, "_comes", [i / parts for i in range(1, parts)]), end]:
            rows.drop("_comes").write.mode("append").parquet(source)
            drain(job(parquet_stream(spark, source, frame.schema)), out, checkpoint)
    return spark.read.parquet(out).where(~F.col(key).eqNullSafe("~end"))


@register("stream_audit", f"{o.chained()} SELECT chain_id, seq, prev_event_hash, event_hash FROM links")
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = audit_records(spark, sf_dir).withColumn("ts", F.to_timestamp("timestamp_utc"))
    got = shuffled(events, "chain_id", lambda s: stream_chain(s, o.SALT, f"{_LATENESS} seconds"))
    return got.select("chain_id", "seq", "prev_event_hash", "event_hash")


@register("stream_audit_shuffled", f"{_odd_links()} SELECT * FROM result")
def stream_audit_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of order, some without a seq, repeated, or with null fields, are chained as in a batch."""
    got = shuffled(odd_records(spark, sf_dir), "chain_id", lambda s: stream_chain(s, o.SALT, f"{_LATENESS} seconds"))
    return got.select(*_LINKS)


@register("stream_verify_links", f"""{o.chained()}, bad AS (SELECT chain_id, seq, CASE WHEN {_HARM[0]} THEN 'changed' ELSE prev_event_hash END AS p,
      event_hash FROM links WHERE NOT ({_HARM[2]}))
    SELECT chain_id, seq, coalesce(p <> lag(event_hash) OVER (PARTITION BY chain_id ORDER BY seq), false) AS broken FROM bad""")
def stream_verify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harmed trail, verified as its records arrive."""
    chained = audit_ops.chain_events(audit_records(spark, sf_dir), o.SALT)
    trail = harmed(chained).withColumn("ts", F.to_timestamp("timestamp_utc"))
    trail = trail.select("chain_id", "seq", "event_id", "ts", "prev_event_hash", "event_hash", F.lit(True).alias("readable"))
    return shuffled(trail, "chain_id", lambda s: stream_verify(s, f"{_LATENESS} seconds")).select("chain_id", "seq", "broken")


@register("turn_block_shuffled", f"WITH {o.turns()} SELECT r AS arrival, event_id, kind, blocked, kind = 'post' AND blocked AS terminate FROM flags, (VALUES (1), (2), (3)) AS t(r)")
def turn_block_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders of arrival give the same answers."""
    turns = stored(v.TURNS.frame(spark, sf_dir).select("conversation_id", "ts", "event_id", "kind", "denied"), "turns")
    out = None
    for seed in (1, 2, 3):
        got = shuffled(turns, "conversation_id", lambda s: ordered_turn_blocks(s, f"{_LATENESS} seconds"), seed=seed, parts=seed)
        got = got.select(F.lit(seed).alias("arrival"), "event_id", "kind", "blocked", "terminate")
        out = got if out is None else out.unionByName(got)
    return out
