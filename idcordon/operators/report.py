"""One report per text, and rollups of hits over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.config import ScanOptions
from idcordon.functions.catalog import SEVERITY_RANK
from idcordon.functions.levels import severity_name
from idcordon.functions.sql import array, choose, lit, name
from idcordon.operators.detect import entity_attributes, entity_name, with_hits
from idcordon.operators.redact import redact_text
from idcordon.operators.resolve import with_spans

# Sentences and risks of a report.
NO_TEXT = "No text provided"
CLEAN = "Clean: No sensitive Indian PII detected."
ALERT = (
    "RBI/SEBI Compliance Alert: Detected %d sensitive PII item(s) (%s). Highest Severity: %s."
)
RISK_CRITICAL, RISK_OTHER = 0.90, 0.70


def breakdown(spans: str, options: ScanOptions = ScanOptions()) -> str:
    """``name: count`` for each kind, in the order in which kinds first occur."""
    return (
        f"array_join(transform(array_distinct(transform({spans}, q -> q.ord)), k -> "
        f"concat({entity_name('k', options)}, ': ', "
        f"cast(size(filter({spans}, q -> q.ord = k)) AS string))), ', ')"
    )


def highest_rank(spans: str) -> str:
    """The gravest rank; 0 without spans."""
    return f"coalesce(array_max(transform({spans}, q -> q.rank)), 0)"


def text_report(
    df: DataFrame, text_col: str = "text", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Scan, resolve, redact and sum up. Keeps the input columns; adds ``spans`` and the report."""
    text = name(text_col)
    found = with_spans(with_hits(df, text_col, options))
    kept = [name(c) for c in found.columns]
    ranked = found.selectExpr(*kept, f"{highest_rank('spans')} AS _rank")
    no_text = f"({text} IS NULL OR {text} = '')"
    severity = severity_name("_rank")
    blocks = options.action_mode == "BLOCK"
    blocked = f"(_rank >= {SEVERITY_RANK[options.min_severity]})" if blocks else "false"
    risk = choose((f"{severity} = 'CRITICAL'", lit(RISK_CRITICAL)), otherwise=lit(RISK_OTHER))
    alert = f"format_string({lit(ALERT)}, size(spans), {breakdown('spans', options)}, {severity})"
    return ranked.selectExpr(
        *kept,
        "size(spans) > 0 AS contains_pii",
        "cast(size(spans) AS bigint) AS total_matches",
        f"{severity} AS highest_severity",
        f"{blocked} AS blocked_by_policy",
        choose((no_text, lit(NO_TEXT)), ("_rank > 0", alert), otherwise=lit(CLEAN))
        + " AS violation_summary",
        choose((no_text, "''"), ("_rank > 0", redact_text(text, "spans")), otherwise=text)
        + " AS redacted_text",
        f"cast(coalesce(length({text}), 0) AS bigint) AS scanned_length",
        choose((blocked, risk), otherwise=lit(0.0)) + " AS pii_risk_score",
    )


def entity_counts(
    df: DataFrame, keys: list[str], spans: str = "spans", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Spans of each kind in each text, with the place at which the kind first occurs."""
    quoted, s = [name(k) for k in keys], name(spans)
    each = (
        f"transform(array_distinct(transform({s}, q -> q.ord)), (k, i) -> named_struct("
        f"'first_seen', i, 'ord', k, 'n', size(filter({s}, q -> q.ord = k))))"
    )
    return df.selectExpr(*quoted, f"explode({each}) AS kind").selectExpr(
        *quoted,
        *entity_attributes("kind.ord", options),
        "cast(kind.first_seen AS bigint) AS first_seen",
        "cast(kind.n AS bigint) AS n_spans",
    )


def detections_rollup(
    df: DataFrame,
    by: list[str],
    groups: list[str] = (),
    spans: str = "spans",
    options: ScanOptions = ScanOptions(),
) -> DataFrame:
    """Spans and texts by attributes of the kind and by columns of the table.

    ``by`` may hold key, name, category and severity. Each text first counts its own
    spans by class, one row per class and text, so grouping needs no distinct count and
    only partial sums are shuffled.
    """
    quoted, s = [name(g) for g in groups], name(spans)
    values = [tuple(getattr(e, b) for b in by) for e in options.catalog]
    classes = list(dict.fromkeys(values))
    class_of = f"get({array(classes.index(v) for v in values)}, q.ord)"
    each = (
        f"transform(array_distinct(transform({s}, q -> {class_of})), k -> named_struct("
        f"'cls', k, 'n', size(filter({s}, q -> {class_of} = k))))"
    )
    summed = (
        df.selectExpr(*quoted, f"explode({each}) AS kind")
        .selectExpr(*quoted, "kind.cls AS _class", "cast(kind.n AS bigint) AS n")
        .groupBy("_class", *groups)
        .agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_texts"))
    )
    outputs = {"key": "entity_type", "name": "entity_name"}
    return summed.selectExpr(
        *[
            f"get({array(c[i] for c in classes)}, _class) AS {outputs.get(b, b)}"
            for i, b in enumerate(by)
        ],
        *quoted,
        "n_spans",
        "n_texts",
    )


#: Attributes of a kind in the order of a cube's columns, and their names there.
CUBE = {"key": "entity_type", "category": "category", "severity": "severity"}


def detections_cube(
    df: DataFrame, groups: list[str] = (), spans: str = "spans", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Spans and texts for every set of the attributes in ``CUBE`` and of ``groups``, as GROUP BY CUBE has them.

    ``grouping_id`` has a bit for each column, the first one highest, set where the column is summed over. Each text
    counts its own spans by class of every set first, so texts are told apart without a distinct
    count, and one shuffle brings partial sums together.
    """
    columns, s = [*CUBE.values(), *groups], name(spans)
    bits = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    attributes = list(CUBE)
    classes: dict[tuple, int] = {}  # the bits of a set and the values of its attributes
    of_kind = [
        [classes.setdefault(_class(e, kept, bits), len(classes)) for kept in _subsets(attributes)] for e in options.catalog
    ]
    ids = f"array({', '.join(f'array({", ".join(map(str, x))})' for x in of_kind)})" if of_kind else "cast(array() AS array<array<int>>)"
    each = (
        f"transform(array_distinct(flatten(transform({s}, q -> get({ids}, q.ord)))), k -> named_struct("
        f"'cls', k, 'n', size(filter({s}, q -> array_contains(get({ids}, q.ord), k)))))"
    )
    sides = [(sum(bits[g] for g in groups if g not in kept), kept) for kept in _subsets(list(groups))]
    sets = ", ".join(
        f"named_struct('bits', {over}, {', '.join(f'{lit(g)}, {name(g) if g in kept else "NULL"}' for g in groups)})"
        if groups else f"named_struct('bits', {over})"
        for over, kept in sides
    )
    counted = df.selectExpr(*[name(g) for g in groups], f"explode({each}) AS kind")
    spread = counted.selectExpr("kind", f"explode(array({sets})) AS side").selectExpr("kind.cls AS _class", "cast(kind.n AS bigint) AS n", "side.*")
    summed = spread.groupBy("_class", "bits", *groups).agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_texts"))
    found = list(classes)
    return summed.selectExpr(
        *[f"get({array(c[1].get(a) for c in found)}, _class) AS {out}" for a, out in CUBE.items()],
        *[name(g) for g in groups],
        f"cast(get({array(c[0] for c in found)}, _class) + bits AS bigint) AS grouping_id", "n_spans", "n_texts",
    )


def _subsets(of: list[str]) -> list[tuple[str, ...]]:
    return [tuple(x for i, x in enumerate(of) if n >> i & 1) for n in range(1 << len(of))]


class _Values(dict):
    """Attributes that take part in a set; can be a key."""

    def __hash__(self) -> int:
        return hash(tuple(sorted(self.items())))


def _class(entity, kept: tuple[str, ...], bits: dict[str, int]) -> tuple[int, _Values]:
    over = sum(bits[out] for a, out in CUBE.items() if a not in kept)
    return over, _Values({a: getattr(entity, a) for a in kept})


def framework_rollup(
    df: DataFrame, groups: list[str] = (), spans: str = "spans", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Spans by regulatory framework: sums per kind first, then the few rows fan out."""
    kinds = entity_counts(df, list(groups), spans, options)
    return (
        kinds.groupBy("regulatory_frameworks", *groups)
        .agg(F.sum("n_spans").alias("n"))
        .select(*groups, F.explode("regulatory_frameworks").alias("framework"), "n")
        .groupBy("framework", *groups)
        .agg(F.sum("n").alias("n_spans"))
    )
