"""Blocked turns over a stream of events; the same rule as the batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from idcordon.config import BLOCK_SECONDS
from idcordon.streaming.ordered import in_order

#: A conversation in order is folded in stretches of so many seconds at least.
STRETCH_SECONDS = 3600

#: Answered rows that are handed on as one group.
GROUP_ROWS = 2000

_OUT = "conversation_id string, event_id bigint, kind string, blocked boolean, terminate boolean"


def _settled_inside(life: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answer events by the last prompt or after-event before them in their stretch of a conversation.

    Takes all events of a stretch in one partition. Adds ``answer``: 1 blocked, 0 not, -1 unknown, as nothing in the stretch
    is before it; and ``deal``: 0 for unknown ones and the last prompt or after-event of a stretch, from which the
    flag goes on to the next one, else a number that deals the rows to groups.
    """
    top = np.iinfo(np.int64).max

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        narrow = pa.Table.from_batches([b.select(["conversation_id", "event_id", "at", "stretch", "kind", "denied"]) for b in got])

        def of(column: str, absent: object) -> np.ndarray:
            return pc.fill_null(narrow[column], absent).to_numpy()

        conversation = pc.fill_null(narrow["conversation_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        order = np.lexsort((of("event_id", top), of("at", top), conversation))
        conversation, at, stretch = conversation[order], of("at", top)[order], of("stretch", top)[order]
        prompt, post = (pc.fill_null(pc.equal(narrow["kind"], kind), False).to_numpy()[order] for kind in ("prompt", "post"))
        sets, denied = prompt | post, of("denied", False)[order]
        n, place = len(order), np.arange(len(order))
        starts = np.ones(n, bool)
        starts[1:] = (conversation[1:] != conversation[:-1]) | (stretch[1:] != stretch[:-1])
        start = np.maximum.accumulate(np.where(starts, place, 0))
        last = np.maximum.accumulate(np.where(sets, place, -1))
        before = np.concatenate(([-1], last[:-1]))
        known = before >= start
        timed = (at != top) & (at[before] != top)
        blocked = known & ~prompt & prompt[before] & denied[before] & timed
        blocked[blocked] = (at - at[before])[blocked] < life
        answered = known | prompt
        ends = last[np.append(starts[1:], True)]
        passed_on = ~answered
        passed_on[ends[ends >= start[np.append(starts[1:], True)]]] = True
        answer, held = np.empty(n, np.int32), np.empty(n, bool)
        answer[order] = np.where(answered, blocked, -1)
        held[order] = passed_on
        base = TaskContext.get().partitionId() << 32
        deal = np.where(held, 0, base + 1 + place // GROUP_ROWS)
        done = 0
        for b in got:
            rows = slice(done, done := done + b.num_rows)
            columns = [pa.array(answer[rows]), pa.array(deal[rows])]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "answer", "deal"])

    return settle


def stream_turn_blocks(
    events: DataFrame,
    seconds: int = BLOCK_SECONDS,
    lateness: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Blocked and terminate for each event of a stream.

    ``events``: conversation_id, ts, event_id, kind (prompt, tool, post), denied. State is
    the time of the last denial; the next prompt or after-event ends it. Times are event times.
    Events of one micro-batch are sorted; the flag is handed on to the next one. A busy conversation is many tasks': its
    hours are answered each on its own first, and only events before an hour's first prompt or after-event, and its last one,
    meet in one task, which holds the state. A task holds its share of a micro-batch, so bound the batches (``files_per_batch``).

    With ``lateness`` (such as ``10 minutes``) events may come so much out of order, and a denial
    of a conversation that ends on it is forgotten once no event can be blocked by it any more.
    Without it such a denial stays in the state. Late events are dropped by the state's task, so all rows of a conversation in
    one micro-batch are one task's there. ``carry`` names further columns to keep.
    """
    life = seconds * 1_000_000
    kept = events.select(*carry).schema

    def flagged_rows(rows: pd.DataFrame, flags: object) -> pd.DataFrame:
        out = rows[["conversation_id", "event_id", "kind"]].assign(blocked=flags)
        out = out.assign(terminate=out["blocked"] & (out["kind"] == "post"))
        return out.assign(record=rows["record"]) if carry else out

    def walk(
        key: tuple[str, int], chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if key[1]:
            yield from (flagged_rows(rows, rows["answer"] == 1) for rows in chunks)
            return
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(chunks)).sort_values(["at", "event_id"], kind="stable")
        flags = []
        for at, kind, denied, answer in zip(rows["at"], rows["kind"], rows["denied"], rows["answer"]):
            blocked = kind != "prompt" and since is not None and at - since < life
            flags.append(blocked if answer < 0 else answer == 1)
            if kind == "prompt":
                since = int(at) if denied and not pd.isna(at) else None
            elif kind == "post":
                since = None
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since,))
            if lateness:
                end = (since + life) // 1000 + 1
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield flagged_rows(rows, flags)

    if lateness:
        events = events.withWatermark("ts", lateness)
    narrow = events.select(
        *(["ts"] if lateness else []),
        "conversation_id",
        F.col("event_id").cast("bigint").alias("event_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "kind",
        F.coalesce("denied", F.lit(False)).alias("denied"),
        *([F.to_json(F.struct(*carry)).alias("record")] if carry else []),
    )
    if lateness:
        dealt = narrow.selectExpr("*", "-1 AS answer", "0L AS deal")
    else:
        dealt = narrow.withColumn("stretch", F.expr(f"at div {STRETCH_SECONDS * 1_000_000}")).repartition("conversation_id", "stretch")
        settled = T.StructType([*dealt.schema, T.StructField("answer", T.IntegerType()), T.StructField("deal", T.LongType())])
        dealt = dealt.mapInArrow(_settled_inside(life), settled).drop("stretch")
    flagged = dealt.withColumn("of", F.expr("if(deal = 0, conversation_id, NULL)")).groupBy("of", "deal").applyInPandasWithState(
        walk, _OUT + (", record string" if carry else ""), "since bigint", "append",
        GroupStateTimeout.EventTimeTimeout if lateness else GroupStateTimeout.NoTimeout,
    )
    if not carry:
        return flagged
    return flagged.withColumn("record", F.from_json("record", kept)).select(*flagged.columns[:-1], "record.*")


def ordered_turn_blocks(events: DataFrame, lateness: str, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Blocked and terminate for each event of a stream whose events arrive in any order within ``lateness``.

    As ``turn_blocks``, whatever the order of arrival; an answer waits until the watermark has passed its event.
    ``events`` as for ``stream_turn_blocks``. A conversation is folded in stretches of an hour, or of ``seconds`` if that is
    more, so that a busy one is not one task's: prompts and after-events of the end of a stretch, by which the next one's events
    can be blocked, go into that one too. State of a stretch is the time of its last denial, which a timer
    removes once no event can be blocked by it, and its events within the lateness. An event
    that comes later than that is answered by its stretch's flag as it stands and doesn't change it.
    """
    life = seconds * 1_000_000
    length = max(seconds, STRETCH_SECONDS) * 1_000_000

    def held(since: int | None, e: dict) -> bool:
        return e["kind"] != "prompt" and since is not None and 0 <= e["at"] - since < life

    def answer(since: int | None, e: dict) -> dict | None:
        return None if e["copy"] else {"blocked": held(since, e), "terminate": held(since, e) and e["kind"] == "post"}

    def step(since: int | None, e: dict) -> tuple[int | None, dict | None]:
        given = answer(since, e)
        if e["kind"] == "prompt":
            return (e["at"] if e["denied"] else None), given
        return (None if e["kind"] == "post" else since), given

    own = f"(at - pmod(at, {length})) div {length}"
    narrow = events.select(
        "conversation_id", "ts", F.col("event_id").cast("bigint").alias("event_id"), "kind",
        F.coalesce("denied", F.lit(False)).alias("denied"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    ).select("*", F.explode(F.expr(
        f"if(kind IN ('prompt', 'post') AND pmod(at, {length}) >= {length - life}, array({own}, {own} + 1), array({own}))"
    )).alias("stretch"))
    narrow = narrow.withColumn("copy", F.expr(f"coalesce(stretch <> {own}, false)"))
    place = "concat('[', at, ',', to_json(array_compact(array(event_id))), ',0]')"
    record = ["conversation_id", "event_id", "kind", "denied", "at", "copy"]
    flagged = in_order(narrow, "conversation_id", "ts", place, record, lateness, step, answer, idle=seconds * 1000, stretch="stretch")
    return flagged.select(
        F.from_json("record", "conversation_id string, event_id bigint, kind string").alias("r"),
        F.from_json("given", "blocked boolean, terminate boolean").alias("g"),
    ).select("r.*", "g.*")
