"""Options of a guard job."""

from __future__ import annotations

from dataclasses import dataclass, field

from idcordon.functions.catalog import CATEGORIES, ENTITIES, SEVERITY_RANK, Entity, without

# What to do with a text that holds identifiers.
ACTION_MODES = ("BLOCK", "MASK", "WARN", "AUDIT")


@dataclass(frozen=True)
class ScanOptions:
    """How texts are scanned.

    ``allowed`` identifiers are never searched; with ``strict`` off every hit counts.
    """

    action_mode: str = "BLOCK"
    min_severity: str = "HIGH"
    strict: bool = True
    allowed: tuple[str, ...] = ()
    catalog: tuple[Entity, ...] = field(default=ENTITIES)

    def __post_init__(self) -> None:
        if self.action_mode not in ACTION_MODES:
            raise ValueError(f"action_mode must be one of {ACTION_MODES}")
        if self.min_severity not in SEVERITY_RANK:
            raise ValueError(f"min_severity must be one of {tuple(SEVERITY_RANK)}")
        for entity in self.catalog:
            if entity.severity not in SEVERITY_RANK or entity.category not in CATEGORIES:
                raise ValueError(f"{entity.key}: unknown severity or category")

    @property
    def entities(self) -> tuple[Entity, ...]:
        return without(self.allowed, self.catalog)


@dataclass(frozen=True)
class PolicyOptions:
    """How answers of the safety filter are judged: BLOCK, FORCE_ASK or anything else (allow)."""

    action_on_match: str = "BLOCK"
    injection_threshold: str = "LOW_AND_ABOVE"
    responsible_ai_threshold: str = "MEDIUM_AND_ABOVE"


# Life of a turn's block flag in seconds, days an audit record is kept,
# the link of the first record of a chain, and the frameworks of an audit record that
# names none.
BLOCK_SECONDS = 300
RETENTION_DAYS = 2555
GENESIS = "GENESIS_BLOCK_FSI_INDIA_0000000000000000"
DEFAULT_FRAMEWORKS = ("RBI_MD_IT_2023", "SEBI_CSCRF_2024", "DPDP_ACT_2023")
