"""Write masks into texts and apply the enforcement mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.config import ScanOptions
from idcordon.functions.sql import choose, let, name

_BLOCK = 128


def redact_text(text: str, spans: str) -> str:
    """The text with every disjoint span replaced by its mask, from left to right.

    ``substring`` counts characters from the start, so a long text is first cut into
    stretches of some spans each and the spans are then placed inside their stretch.
    """

    def end_before(i: str) -> str:
        return f"coalesce(get({spans}, {i} - 1).end, 0)"

    stop = end_before(f"least((k + 1) * {_BLOCK}, size({spans}))")
    stretch = let(
        f"named_struct('begin', {end_before(f'k * {_BLOCK}')}, "
        f"'inside', slice({spans}, k * {_BLOCK} + 1, {_BLOCK}))",
        "c",
        let(
            f"substring({text}, c.begin + 1, {stop} - c.begin)",
            "piece",
            "array_join(transform(c.inside, (m, i) -> concat(substring(piece, "
            "coalesce(get(c.inside, i - 1).end, c.begin) - c.begin + 1, "
            "m.start - coalesce(get(c.inside, i - 1).end, c.begin)), m.masked)), '')",
        ),
    )
    blocks = f"sequence(0, cast((size({spans}) - 1) div {_BLOCK} AS int))"
    tail = f"substring({text}, {end_before(f'size({spans})')} + 1)"
    return choose(
        (
            f"size({spans}) > 0",
            f"concat(array_join(transform({blocks}, k -> {stretch}), ''), {tail})",
        ),
        otherwise=text,
    )


def apply_action_mode(
    reports: DataFrame, text_col: str = "text", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """What leaves the guard: the text as it was, redacted, or nothing when blocked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mode = options.action_mode
    acts = F.col("blocked_by_policy") if mode == "BLOCK" else F.col("contains_pii")
    passed = {
        "BLOCK": F.when(~F.col("blocked_by_policy"), text),
        "MASK": F.col("redacted_text"),
    }.get(mode, text)
    warning = F.when(acts, F.col("violation_summary")) if mode == "WARN" else F.lit(None)
    return reports.select(
        "*",
        F.when(acts, mode).otherwise("ALLOW").alias("action_taken"),
        passed.alias("text_out"),
        warning.cast("string").alias("warning"),
    )
