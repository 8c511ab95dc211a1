"""From texts to identifier hits.

Every identifier kind is one native regex pass over the text column. All passes run in
the same stage as the scan, in the row, without a shuffle. Offsets come from the text
between hits: hit *i* ends where all gaps and hits up to *i* end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.config import ScanOptions
from idcordon.functions.catalog import SEVERITY_RANK, Entity
from idcordon.functions.masks import mask
from idcordon.functions.regex import jvm_pattern
from idcordon.functions.sql import array, empty, fold_emit, lit, name, once, pattern
from idcordon.functions.validators import RULES

# A hit in a row: offsets in characters, place of its kind in the catalog, severity
# rank and mask. The raw value is not carried on.
SPAN = "struct<start:int,end:int,ord:int,rank:int,masked:string>"


def _passes(text: str, gate: str) -> str:
    if gate == "@":
        return f"contains({text}, '@')"
    return f"rlike({text}, {pattern(jvm_pattern(gate))})"


def _spans(text: str, hits: str, entity: Entity, ord_: int, strict: bool) -> str:
    """Offsets, check and mask of the hits of one kind."""
    # One compiled pattern serves all rows; ``split`` would compile anew for each.
    regex = pattern(jvm_pattern(entity.pattern, entity.lead, gaps=True))
    gaps = f"regexp_extract_all({text}, {regex}, 1)"
    values = f"transform({hits}, h -> named_struct('hit', h, 'value', h))"
    if entity.context:
        # In every pattern with context the group ends where the hit ends.
        values = (
            f"zip_with({hits}, regexp_extract_all({text}, {regex}, 2), "
            "(h, g) -> named_struct('hit', h, 'value', if(g = '', h, g)))"
        )
    parts = (
        f"zip_with({values}, {gaps}, "
        "(v, gap) -> named_struct('advance', length(gap) + length(v.hit), 'value', v.value))"
    )
    placed = fold_emit(
        parts,
        "0",
        "struct<end:int,value:string>",
        "a.carry + x.advance",
        "array(named_struct('end', n, 'value', x.value))",
    )
    if strict and entity.check:
        placed = f"filter({placed}, p -> {RULES[entity.check]('p.value')})"
    return (
        f"transform({placed}, p -> named_struct("
        "'start', p.end - length(p.value), 'end', p.end, "
        f"'ord', {ord_}, 'rank', {SEVERITY_RANK[entity.severity]}, "
        f"'masked', {mask(entity.key, 'p.value')}))"
    )


def with_hits(
    df: DataFrame, text_col: str = "text", options: ScanOptions = ScanOptions(), out: str = "hits"
) -> DataFrame:
    """Add an array of all valid hits, in catalog order and then by place."""
    text = name(text_col)
    entities = options.entities
    kept = [F.col(name(c)) for c in df.columns]
    if not entities:
        return df.select(*kept, F.expr(empty(SPAN)).alias(out))

    # One cheap test per distinct gate; most texts pass none and are left alone.
    gates = {g: f"_gate_{i}" for i, g in enumerate({e.gate: 0 for e in entities if e.gate})}
    worth = r"rlike({0}, r'(?U)[\d@]')".format(text)
    guarded = all(e.gate for e in entities)
    gated = df.select(*kept, F.expr(worth if guarded else "true").alias("_worth")).select(
        *kept, *[F.expr(f"_worth AND {_passes(text, g)}").alias(c) for g, c in gates.items()]
    )

    def found(e: Entity) -> str:
        every = f"regexp_extract_all({text}, {pattern(jvm_pattern(e.pattern, e.lead))}, 0)"
        return f"if({gates[e.gate]}, {every}, NULL)" if e.gate else every

    names = [f"_hits_{i}" for i in range(len(entities))]
    matched = gated.select(
        *kept, *[F.expr(found(e)).alias(n) for e, n in zip(entities, names)]
    )
    spans = [
        f"if(size({n}) > 0, {_spans(text, n, e, options.catalog.index(e), options.strict)}, "
        f"{empty(SPAN)})"
        for e, n in zip(entities, names)
    ]
    any_hit = " OR ".join(f"size({n}) > 0" for n in names)
    hits = f"if({any_hit}, concat({', '.join(spans)}), {empty(SPAN)})"
    return matched.selectExpr(*[name(c) for c in df.columns], once(hits, name(out)))


def entity_type(ord_: str, options: ScanOptions = ScanOptions()) -> str:
    return f"get({array(e.key for e in options.catalog)}, {ord_})"


def entity_name(ord_: str, options: ScanOptions = ScanOptions()) -> str:
    return f"get({array(e.name for e in options.catalog)}, {ord_})"


def entity_frameworks(ord_: str, options: ScanOptions = ScanOptions()) -> str:
    lists = ", ".join(
        f"cast({array(e.frameworks)} AS array<string>)" for e in options.catalog
    )
    return f"get(array({lists}), {ord_})"


def entity_attributes(ord_: str, options: ScanOptions = ScanOptions()) -> list[str]:
    """Type, name, category, severity and frameworks of a hit, for ``selectExpr``."""
    catalog = options.catalog
    return [
        f"{entity_type(ord_, options)} AS entity_type",
        f"{entity_name(ord_, options)} AS entity_name",
        f"get({array(e.category for e in catalog)}, {ord_}) AS category",
        f"get({array(e.severity for e in catalog)}, {ord_}) AS severity",
        f"{entity_frameworks(ord_, options)} AS regulatory_frameworks",
    ]


def explode_spans(
    df: DataFrame, keys: list[str], spans: str = "hits", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """One row per hit: the keys, the kind's attributes, offsets and mask."""
    quoted = [name(k) for k in keys]
    one = df.selectExpr(*quoted, f"posexplode({name(spans)}) AS (span_no, span)")
    return one.selectExpr(
        *quoted,
        "cast(span_no AS bigint) AS span_no",
        *entity_attributes("span.ord", options),
        "cast(span.start AS bigint) AS start_index",
        "cast(span.end AS bigint) AS end_index",
        "span.masked AS masked_value",
        # An invalid hit is dropped, so every hit that is left has the same standing.
        f"{lit(0.98)} AS confidence",
        "true AS checksum_valid",
    )


def scan_spans(
    df: DataFrame,
    keys: list[str],
    text_col: str = "text",
    options: ScanOptions = ScanOptions(),
) -> DataFrame:
    """All valid hits of all kinds, overlaps included, one row each."""
    narrow = df.select(*keys, text_col)
    return explode_spans(with_hits(narrow, text_col, options), keys, "hits", options)
