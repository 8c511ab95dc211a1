"""Blocked turns: a denied prompt holds back the tools of its conversation for a while.

Batch form. Rows are events with a conversation, a time, an id that orders events of
the same time, a kind (prompt, tool, post) and, for prompts, whether it was denied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from idcordon.config import BLOCK_SECONDS
from idcordon.functions.sql import name
from idcordon.operators.lookback import last_before


def turn_blocks(
    events: DataFrame,
    conversation: str = "conversation_id",
    ts: str = "ts",
    event_id: str = "event_id",
    seconds: int = BLOCK_SECONDS,
    stretch: str = "HOUR",
) -> DataFrame:
    """Add ``blocked`` (tool and after-events of a blocked turn) and ``terminate``.

    A prompt clears the flag and sets it when denied; an after-event clears it. So only
    the last earlier prompt or after-event counts.
    """
    t = name(ts)
    state = f"if(kind IN ('prompt', 'post'), named_struct('set', kind = 'prompt' AND denied, 'at', {t}), NULL)"
    found = last_before(
        events, [conversation], [ts, event_id], f"date_trunc('{stretch}', {t})", {"_flag": state}
    )
    young = f"timestampdiff(MICROSECOND, _flag.at, {t}) < {seconds} * 1000000L"
    blocked = f"kind <> 'prompt' AND coalesce(_flag.set AND {young}, false)"
    return found.selectExpr(
        *[name(c) for c in events.columns],
        f"{blocked} AS blocked",
        f"kind = 'post' AND {blocked} AS terminate",
    )
