"""The audit trail: events, hash chains, their verification, tail and retention."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idcordon.config import (
    DEFAULT_FRAMEWORKS, GENESIS, RETENTION_DAYS, ScanOptions,
)
from idcordon.functions.canonical import event_hash, hash_parts
from idcordon.functions.sql import array, choose, empty, lit, name
from idcordon.operators.detect import entity_frameworks, entity_name, entity_type
from idcordon.operators.lookback import last_before

_ENTITY = (
    "struct<entity_type:string,entity_name:string,category:string,severity:string,"
    "masked_value:string,start_index:bigint,end_index:bigint,confidence:double,"
    "checksum_valid:boolean,regulatory_frameworks:array<string>>"
)


def utc_clock(df: DataFrame, ts: str) -> str:
    """Wall clock of a time column in UTC, whatever the session's zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return f"cast({name(ts)} AS timestamp)"
    return f"to_utc_timestamp({name(ts)}, current_timezone())"


def iso_utc(clock: str) -> str:
    """ISO form; microseconds only when there are some."""
    micros = f"date_format({clock}, 'SSSSSS')"
    return (
        f"concat(date_format({clock}, \"yyyy-MM-dd'T'HH:mm:ss\"), "
        f"if({micros} = '000000', '', concat('.', {micros})), '+00:00')"
    )


def india_time(clock: str) -> str:
    return f"concat(date_format({clock} + INTERVAL '05:30' HOUR TO MINUTE, 'yyyy-MM-dd HH:mm:ss'), ' IST')"


def audit_events(
    gated: DataFrame,
    chain: str,
    seq: str,
    ts: str,
    hook_name: str,
    event_type: str = "'PRE_INVOCATION'",
    metadata: str = "map('stage', stage)",
    step_idx: str = "cast(NULL AS bigint)",
    log_allowed: bool = False,
    log_turn_denials: bool = False,
    options: ScanOptions = ScanOptions(),
) -> DataFrame:
    """One event for each denied or asked text of a gate (see ``gate``).

    The id is made of chain, seq and hook, so that a rerun gives the same events. Texts that
    were let through, and those denied because of their turn, are logged on request.
    """
    clock = utc_clock(gated, ts)
    logged = "verdict <> 'allow'" if not log_allowed else "true"
    if not log_turn_denials:
        logged += " AND stage <> 'turn'"
    catalog = options.catalog
    entity = (
        f"named_struct('entity_type', {entity_type('q.ord', options)}, "
        f"'entity_name', {entity_name('q.ord', options)}, "
        f"'category', get({array(e.category for e in catalog)}, q.ord), "
        f"'severity', get({array(e.severity for e in catalog)}, q.ord), "
        "'masked_value', q.masked, 'start_index', cast(q.start AS bigint), "
        "'end_index', cast(q.end AS bigint), 'confidence', 0.98D, 'checksum_valid', true, "
        f"'regulatory_frameworks', {entity_frameworks('q.ord', options)})"
    )
    shown = f"concat({entity_name('q.ord', options)}, ' (', q.masked, ')')"
    none = empty("string")
    key = f"concat_ws('|', {name(chain)}, cast({name(seq)} AS string), {lit(hook_name)})"
    return gated.where(logged).selectExpr(
        f"cast({name(chain)} AS string) AS chain_id",
        f"cast({name(seq)} AS bigint) AS seq",
        f"concat('FSI-', upper(left(sha2({key}, 256), 12))) AS event_id",
        f"{iso_utc(clock)} AS timestamp_utc",
        f"{india_time(clock)} AS timestamp_ist",
        f"to_date({clock}) AS event_date",
        f"cast({name(chain)} AS string) AS conversation_id",
        f"{step_idx} AS step_idx",
        f"{lit(hook_name)} AS hook_name",
        f"{event_type} AS event_type",
        "coalesce(policy_decision, verdict) AS decision",
        "reason",
        "risk_score",
        choose(
            ("stage = 'identifiers'", f"transform(spans, q -> {shown})"),
            ("stage = 'policy'", "policy_violations"),
            otherwise=none,
        )
        + " AS detected_violations",
        choose(("stage = 'identifiers'", f"transform(spans, q -> {entity})"), otherwise=empty(_ENTITY))
        + " AS masked_entities",
        choose(
            ("stage = 'policy' AND size(policy_codes) > 0", "policy_codes"),
            otherwise=array(DEFAULT_FRAMEWORKS),
        )
        + " AS regulatory_frameworks",
        f"{metadata} AS caller_metadata",
    )


def last_hashes(trail: DataFrame, chain: str = "chain_id", seq: str = "seq") -> DataFrame:
    """The end of each chain, from which the next batch goes on: its hash and place (last_seq, last_event_id)."""
    end = F.max(F.struct(F.col(name(seq)).cast("bigint").alias("seq"), "event_id", "event_hash")).alias("end")
    ends = trail.where(f"event_hash IS NOT NULL AND {name(seq)} IS NOT NULL").groupBy(name(chain)).agg(end)
    return ends.select(
        name(chain), F.col("end.event_hash").alias("last_hash"), F.col("end.seq").alias("last_seq"), F.col("end.event_id").alias("last_event_id")
    )


def chain_events(
    events: DataFrame,
    salt: str,
    chain: str = "chain_id",
    seq: str = "seq",
    resume: DataFrame | None = None,
) -> DataFrame:
    """The events with ``prev_event_hash`` and ``event_hash``; ``resume``: chain and last_hash to go on from.

    An event's place in its chain is (seq, event_id). Events without a seq have no place, and of
    events that repeat a place only the first one, by content, has it: the others come out with
    null hashes and leave the chain as it is. So no event is lost and none is chained twice.

    The text to be hashed is made in the JVM. One shuffle brings each chain together and sorts
    it, spilling where it must; a task then walks its rows and keeps only the last hash. A null
    chain id is a chain like any other. A chain is serial by its nature.
    """
    head, tail = hash_parts(salt)
    kept = events.columns
    prepared = events.selectExpr(
        *[name(c) for c in kept], f"cast({name(seq)} AS bigint) AS _seq", f"{head} AS _head", f"{tail} AS _tail", "false AS _mark"
    )
    if resume is not None:  # stands before a chain's first event
        ends = resume.selectExpr(name(chain), "last_hash AS _head", "true AS _mark")
        prepared = prepared.unionByName(ends, allowMissingColumns=True)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, place, started = None, GENESIS, None, False
        for b in batches:
            before, after = [], []
            for key, at, own, start, end, mark in zip(*(b.column(c).to_pylist() for c in (chain, "_seq", "event_id", "_head", "_tail", "_mark"))):
                if key != of or not started:
                    of, last, place, started = key, GENESIS, None, True
                if mark:
                    last = start
                linked = not mark and at is not None and (at, own) != place
                before.append(last if linked else None)
                if linked:
                    place, last = (at, own), hashlib.sha256(f"{start}{last}{end}".encode()).hexdigest()
                after.append(last if linked else None)
            rows = pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(before, pa.string()), pa.array(after, pa.string())],
                names=[*kept, "prev_event_hash", "event_hash"],
            )
            yield rows.filter(pc.invert(b.column("_mark")))

    hashes = [T.StructField(c, T.StringType()) for c in ("prev_event_hash", "event_hash")]
    order = [F.col(name(chain)), F.col("_mark").desc(), F.col("_seq").asc_nulls_last(), "event_id", "_head", "_tail"]
    return (
        prepared.repartition(F.col(name(chain)))
        .sortWithinPartitions(*order)
        .mapInArrow(walk, T.StructType([*events.schema.fields, *hashes]))
    )


def chain_links(
    events: DataFrame,
    salt: str,
    chain: str = "chain_id",
    seq: str = "seq",
    resume: DataFrame | None = None,
) -> DataFrame:
    """Previous and own hash of each event: (chain, seq, event_id, prev_event_hash, event_hash). See ``chain_events``."""
    linked = chain_events(events, salt, chain, seq, resume)
    return linked.selectExpr(name(chain), f"cast({name(seq)} AS bigint) AS seq", "event_id", "prev_event_hash", "event_hash")


#: Rows that have no place in their chain (see ``chain_events``): both hashes are null.
UNLINKED = "prev_event_hash IS NULL AND event_hash IS NULL"


def verify_links(
    trail: DataFrame, chain: str = "chain_id", seq: str = "seq", stretch: int = 100_000
) -> DataFrame:
    """Mark records whose previous hash is not the hash before them, and unreadable ones.

    The first record of a chain has nothing before it and is exempt, as are records without a
    place. A record that lost both hashes is found by the one after it.
    """
    if "readable" not in trail.columns:
        trail = trail.select("*", F.lit(True).alias("readable"))
    # Unreadable records and those without a place have no hash of their own and leave the one before in force.
    counts = f"NOT readable OR NOT ({UNLINKED})"
    looked = last_before(
        trail.withColumn("_counts", F.expr(counts)),
        [chain],
        [c for c in (seq, "event_id") if c in trail.columns],
        f"{name(seq)} div {stretch}",
        {"_any": "if(_counts, true, NULL)", "_before": "if(readable AND _counts, coalesce(event_hash, ''), NULL)"},
    )
    return looked.selectExpr(
        *[name(c) for c in trail.columns],
        "NOT readable OR (_counts AND _any IS NOT NULL AND "
        f"NOT (prev_event_hash <=> coalesce(_before, {lit(GENESIS)}))) AS broken",
    )


def verify_hashes(trail: DataFrame, salt: str) -> DataFrame:
    """Take every hash anew from the stored record and compare; records without a place have none to compare."""
    return trail.select(
        "*", F.expr(f"NOT ({UNLINKED}) AND coalesce(event_hash <> {event_hash(salt)}, true)").alias("altered")
    )


def audit_tail(trail: DataFrame, order: list[str | Column], n: int = 10) -> DataFrame:
    """The last records: a top-n, of which each task sends at most n."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    return trail.orderBy(*[k.desc() for k in keys]).limit(n)


def retained(trail: DataFrame, today: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Records that are kept on ``today`` (an SQL date); prunes partitions by ``event_date``."""
    return trail.where(F.expr(f"event_date >= date_sub({today}, {days})"))
