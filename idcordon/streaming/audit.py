"""Append audit events of a stream to their chains, and verify a trail as it arrives."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.config import GENESIS
from idcordon.functions.canonical import hash_parts
from idcordon.functions.sql import name
from idcordon.streaming.ordered import in_order

_PLACE = "CASE WHEN seq IS NOT NULL THEN concat('[', seq, ',', to_json(array_compact(array(event_id))), ',', to_json(array({0})), ']') END"


def _link(last: Any, record: dict) -> tuple[Any, dict]:
    last = last or GENESIS
    own = hashlib.sha256(f"{record['_head']}{last}{record['_tail']}".encode()).hexdigest()
    return own, {"prev_event_hash": last, "event_hash": own}


def _unlinked(last: Any, record: dict) -> dict:
    return {}


def stream_chain(events: DataFrame, salt: str, lateness: str, ts: str = "ts") -> DataFrame:
    """Audit events (see ``audit_events``, with their time ``ts``) with their previous and own hash.

    Events may come out of order by so much ``lateness``: each chain is linked in the order of
    (seq, event_id), as the batch form does, whatever the order of arrival. Events without a seq, repeats, and
    events that come after their place was passed come out with null hashes, as there. State
    is the last hash of each chain and its events within the lateness.
    """
    head, tail = hash_parts(salt)
    schema = events.schema
    parts = events.select("*", F.expr(head).alias("_head"), F.expr(tail).alias("_tail"))
    linked = in_order(parts, "chain_id", ts, _PLACE.format("_head, _tail"), parts.columns, lateness, _link, _unlinked)
    return linked.select(
        F.from_json("record", schema).alias("r"), F.from_json("given", "prev_event_hash string, event_hash string").alias("g")
    ).select("r.*", "g.*")


def _check(before: Any, record: dict) -> tuple[Any, dict]:
    if not record["readable"]:
        return before or [None], {"broken": True}
    if record["prev_event_hash"] is None and record["event_hash"] is None:
        return before, {"broken": False}
    broken = before is not None and record["prev_event_hash"] != (before[0] if before[0] is not None else GENESIS)
    return [record["event_hash"] or ""], {"broken": broken}


def _unplaced(before: Any, record: dict) -> dict:
    """Late, repeated or without a place: broken unless it is a record that never had one."""
    return {"broken": not record["readable"] or record["prev_event_hash"] is not None or record["event_hash"] is not None}


def stream_verify(trail: DataFrame, lateness: str, ts: str = "ts") -> DataFrame:
    """Records of a trail that arrives, with ``broken`` as ``verify_links`` has it.

    State is the last hash of each chain. A record that comes after its place was passed, or that
    repeats a place, is broken.
    """
    if "readable" not in trail.columns:
        trail = trail.withColumn("readable", F.lit(True))
    schema = trail.schema
    checked = in_order(trail, "chain_id", ts, _PLACE.format("coalesce(prev_event_hash, '')"), trail.columns, lateness, _check, _unplaced)
    return checked.select(
        F.from_json("record", schema).alias("r"), F.from_json("given", "broken boolean").alias("g")
    ).select(*[F.col(f"r.{name(c)}") for c in trail.columns], "g.broken")
