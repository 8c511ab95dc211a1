"""Scan texts as they arrive. Stateless: the batch operators run on the stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from idcordon.config import ScanOptions
from idcordon.operators.redact import apply_action_mode
from idcordon.operators.report import text_report


def stream_scan(
    stream: DataFrame, keys: list[str], text_col: str = "text", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """A report for each arriving text, with the action taken and the text that leaves."""
    reports = text_report(stream.select(*keys, text_col), text_col, options)
    return apply_action_mode(reports, text_col, options).drop("spans", text_col)
