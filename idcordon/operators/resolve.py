"""Overlapping hits: keep the severer, then the longer, walking from the left."""

from __future__ import annotations

from pyspark.sql import DataFrame

from idcordon.functions.sql import choose, empty, fold_emit, name, once
from idcordon.operators.detect import SPAN


def resolve_overlaps(hits: str) -> str:
    """Disjoint hits in text order.

    Sorted by start, longest first, severest first, then catalog order. A hit that
    starts inside the last kept one takes its place when it is severer, or as severe
    and longer. The choice depends on earlier choices, so this is a fold, in the row.
    """
    ordered = (
        f"array_sort(transform({hits}, h -> named_struct('start', h.start, "
        "'shorter', h.start - h.end, 'milder', -h.rank, 'ord', h.ord, 'hit', h)))"
    )
    apart = "x.start >= a.carry.end"
    better = (
        "x.rank > a.carry.rank OR (x.rank = a.carry.rank "
        "AND x.end - x.start > a.carry.end - a.carry.start)"
    )
    none = empty(SPAN)
    return fold_emit(
        f"transform({ordered}, o -> o.hit)",
        f"cast(NULL AS {SPAN})",
        SPAN,
        choose((f"a.carry IS NULL OR {apart} OR {better}", "x"), otherwise="a.carry"),
        choose((f"a.carry IS NOT NULL AND {apart}", "array(a.carry)"), otherwise=none),
        choose(("s.carry IS NOT NULL", "array(s.carry)"), otherwise=none),
    )


def with_spans(df: DataFrame, hits: str = "hits", out: str = "spans") -> DataFrame:
    """Replace the hits by the disjoint hits that are kept."""
    h = name(hits)
    kept = choose((f"size({h}) > 1", resolve_overlaps(h)), otherwise=h)
    return df.selectExpr(*[name(c) for c in df.columns if c != hits], once(kept, name(out)))
