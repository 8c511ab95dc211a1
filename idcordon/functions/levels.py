"""Ordered levels: severities of identifiers and confidences of safety filters."""

from __future__ import annotations

from idcordon.functions.catalog import SEVERITY_RANK
from idcordon.functions.sql import choose, lit

# Confidence levels of the safety filters.
CONFIDENCE_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "CONFIDENCE_LEVEL_UNSPECIFIED": 0}


def _rank(level: str, ranks: dict[str, int], default: int) -> str:
    return choose(*[(f"{level} = {lit(n)}", lit(r)) for n, r in ranks.items()], otherwise=lit(default))


def severity_rank(severity: str) -> str:
    """4 for the gravest to 1; 0 for anything else."""
    return _rank(severity, SEVERITY_RANK, 0)


def severity_name(rank: str) -> str:
    """The inverse of :func:`severity_rank`; null for 0."""
    return choose(*[(f"{rank} = {r}", lit(n)) for n, r in SEVERITY_RANK.items()])


def severity_at_least(severity: str, minimum: str) -> str:
    """Compare two severities, each an SQL expression."""
    return f"({severity_rank(severity)} >= {severity_rank(minimum)})"


def confidence_at_least(confidence: str, threshold: str) -> str:
    """Compare with a threshold such as ``MEDIUM_AND_ABOVE``; an unknown one means LOW."""
    bare = f"replace(upper({threshold}), '_AND_ABOVE', '')"
    return f"({_rank(confidence, CONFIDENCE_RANK, 0)} >= {_rank(bare, CONFIDENCE_RANK, 1)})"
