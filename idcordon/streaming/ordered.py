"""Streams whose rows arrive out of order, handed on by key in their true order.

Rows of a key wait in its state until the watermark has passed their time, and are then released in the
order of their place, up to the first row whose time the watermark has not passed. So what
comes out doesn't depend on the order of arrival, as long as rows come within the lateness and the
places of a key are in the order of its times. A row whose place is
not after the last released one, or that has none, is late: it is handed on at once, marked, and
changes nothing.

State of a key: the rows that wait, which its lateness bounds, and a short text that the fold carries from row to row. Rows
are taken up chunk by chunk and wait in chunks of ``CHUNK`` rows, one text each, as the store is asked over a socket. They
are read back only when the watermark has passed the first of them. The store must be RocksDB (see ``tables.drain``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Takes the carried value and a record, gives the value after it and what is given off; None: the row isn't handed on.
Fold = Callable[[Any, dict], tuple[Any, dict | None]]

#: Rows of a chunk of state, and of a batch that is handed on.
CHUNK = 1000


class InOrder(StatefulProcessor):
    """``step`` folds a record in order; ``late`` answers a record that has no place after the last one.

    ``idle``: milliseconds after which a carried value is forgotten, counted from the last released
    row and kept by a timer; None keeps it for ever.
    """

    def __init__(self, step: Fold, late: Callable[[Any, dict], dict | None], idle: int | None = None) -> None:
        self.step, self.late, self.idle = step, late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        # first: time of the first row that waits. timer: when the next look is due.
        self.carried = handle.getValueState("carried", "value string, place string, at bigint, first bigint, timer bigint")

    def _now(self) -> tuple[Any, list | None, int, int | None, int | None]:
        got = self.carried.get()
        if got is None:
            return None, None, 0, None, None
        value, place, at, first, timer = got
        return json.loads(value), json.loads(place) if place else None, at, first, timer

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        value, last, at_last, first, timer = self._now()
        for chunk in rows:
            keep, out = [], []
            for at, place, record in zip(chunk["at"], chunk["place"], chunk["record"]):
                if place is None or pd.isna(place) or (last is not None and json.loads(place) <= last):
                    self._give(out, key, self.late(value, json.loads(record)), record)
                else:
                    keep.append((int(at), place, record))
            if keep:
                self.waiting.appendList(self._chunks(keep))
                least = min(r[0] for r in keep)
                first = least if first is None else min(first, least)
            if out:
                yield self._frame(out)
        if first is not None:
            yield from self._release(key, timerValues.getCurrentWatermarkInMs(), value, last, at_last, first, timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs(), *self._now())

    def _release(
        self, key: Any, passed: int, value: Any, last: list | None, at_last: int, first: int | None, timer: int | None
    ) -> Iterator[pd.DataFrame]:
        """Fold what the watermark has passed, and look again when it passes the first row that is left."""
        if first is not None and first // 1000 < passed:
            rows = [(json.loads(place), at, record) for (chunk,) in self.waiting.get() for at, place, record in json.loads(chunk)]
            rows.sort(key=lambda r: r[0])
            out, released = [], 0
            for place, at, record in rows:
                if at // 1000 >= passed:
                    break
                released += 1
                content = json.loads(record)
                if last is not None and place[:-1] == last[:-1]:  # repeats a place
                    self._give(out, key, self.late(value, content), record)
                else:
                    value, given = self.step(value, content)
                    last, at_last = place, max(at_last, at)
                    self._give(out, key, given, record)
                if len(out) >= CHUNK:
                    yield self._frame(out)
                    out = []
            rest = rows[released:]
            if released:
                self.waiting.clear()
                if rest:
                    self.waiting.put(self._chunks([(at, json.dumps(place), record) for place, at, record in rest]))
            first = rest[0][1] if rest else None
            if out:
                yield self._frame(out)
        due = None
        if first is not None:
            due = max(first // 1000, passed) + 1
        elif self.idle is not None and last is not None:
            due = at_last // 1000 + self.idle + 1
            if passed >= due:
                self.carried.clear()
                return
        if first is None and last is None:
            return
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        self.carried.update((json.dumps(value), json.dumps(last) if last is not None else None, at_last, first, due))

    @staticmethod
    def _chunks(rows: list[tuple[int, str, str]]) -> list[tuple[str]]:
        return [(json.dumps(rows[i : i + CHUNK]),) for i in range(0, len(rows), CHUNK)]

    @staticmethod
    def _give(out: list[tuple[Any, str, str]], key: Any, given: dict | None, record: str) -> None:
        if given is not None:
            out.append((key[0], json.dumps(given), record))

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list[tuple[Any, str, str]]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["of", "given", "record"])


def in_order(
    events: DataFrame, key: str, ts: str, place: str, record: list[str], lateness: str,
    step: Fold, late: Callable[[Any, dict], dict | None], idle: int | None = None, stretch: str | None = None,
) -> DataFrame:
    """(of, given, record): what ``step`` gives off for each row, and the row, both as JSON.

    ``place``: an SQL expression, an array of texts and numbers as JSON that orders the rows of a key; its last part only
    orders rows that repeat a place. Null: the row has none. ``record``: columns that the fold
    reads and that are handed on. ``stretch``: an SQL expression; rows of a key with different
    stretches are folded apart, so that a hot key is not one task's.
    """
    # The time itself isn't handed on, or Spark would drop late rows before they are seen.
    narrow = events.withWatermark(ts, lateness).select(
        F.col(key).cast("string").alias("of"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.expr(place).alias("place"),
        F.to_json(F.struct(*record), {"ignoreNullFields": "false"}).alias("record"),
        *([F.expr(stretch).alias("stretch")] if stretch else []),
    )
    return narrow.groupBy("of", *(["stretch"] if stretch else [])).transformWithStateInPandas(
        InOrder(step, late, idle), "of string, given string, record string", "append", "eventtime"
    )
