"""Regulatory controls: catalogs, mapping of violations, coverage by what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idcordon.config import ScanOptions
from idcordon.functions.sql import lit
from idcordon.operators.report import detections_rollup

# Control ids, titles, references and targets. The sentence of each is our own.
CONTROLS = {
    "RBI": {
        "RBI-ITG-SEC-01": (
            "Customer Data Protection & Privacy",
            "RBI Master Direction on IT Governance 2023, Chapter III, Para 11",
            "Personal and financial data of customers must not reach anyone who has no right to it.",
            ("AADHAAR", "PAN", "BANK_ACCOUNT_IN", "CREDIT_DEBIT_CARD", "CARD_CVV", "UPI_VPA", "PHONE_IN"),
        ),
        "RBI-ITG-SEC-02": (
            "Adversarial Threat & AI Safety Defense",
            "RBI Master Direction on IT Governance 2023, Chapter III, Para 14",
            "Attacks on a model by injected or harmful input have to be found and stopped by machine.",
            ("PROMPT_INJECTION", "MALICIOUS_URIS", "CSAM", "TOXICITY"),
        ),
        "RBI-DPSC-03": (
            "Card Data Security & Non-Storage",
            "RBI Digital Payment Security Controls 2021, Section 4",
            "Card numbers and their security codes may not be sent or shown in the clear.",
            ("CREDIT_DEBIT_CARD", "CARD_CVV"),
        ),
        "RBI-ITG-AUD-04": (
            "Tamper-Resistant Audit Trail",
            "RBI Master Direction on IT Governance 2023, Chapter V, Para 22",
            "Logs of automated systems are kept for seven years in a form that shows changes.",
            ("AUDIT_TRAIL",),
        ),
    },
    "SEBI": {
        "SEBI-CSCRF-AI-01": (
            "AI/ML Input Validation & Algorithmic Guardrails",
            "SEBI CSCRF 2024, Part III, Rule 6.2",
            "What goes into a model is checked at once, so that it can't be misused and no data leaks.",
            ("PROMPT_INJECTION", "JAILBREAK", "RESPONSIBLE_AI"),
        ),
        "SEBI-CSCRF-DP-02": (
            "Client Financial Data Protection",
            "SEBI CSCRF 2024, Part II, Rule 4.1",
            "Clients' tax, depository and account numbers stay out of prompts that aren't cleared for them.",
            ("PAN", "GSTIN", "BANK_ACCOUNT_IN", "CIN_IN", "PASSPORT_IN"),
        ),
        "SEBI-CSCRF-NET-03": (
            "Malicious Network & URI Defense",
            "SEBI CSCRF 2024, Part II, Rule 5.3",
            "Links to places that aren't approved, or that serve fraud or remote control, are held back.",
            ("MALICIOUS_URIS",),
        ),
        "SEBI-CSCRF-LOG-04": (
            "Cryptographic Audit Preservation",
            "SEBI CSCRF 2024, Part IV, Rule 8.4",
            "Every judgement and every block is stored with a hash and can't be rewritten unseen.",
            ("AUDIT_PRESERVATION",),
        ),
    },
    "DPDP": {},
}

# Words in upper-cased violations that bring a control in.
RBI_WORDS = {
    "RBI-ITG-SEC-01": ("AADHAAR", "PAN", "ACCOUNT", "PHONE", "UPI", "CARD", "CVV"),
    "RBI-DPSC-03": ("CARD", "CVV"),
    "RBI-ITG-SEC-02": (
        "PROMPT INJECTION", "JAILBREAK", "MALICIOUS", "PHISHING", "RESPONSIBLE AI",
    ),
}
SEBI_WORDS = {
    "SEBI-CSCRF-DP-02": ("PAN", "GSTIN", "ACCOUNT", "CIN", "PASSPORT"),
    "SEBI-CSCRF-AI-01": ("PROMPT INJECTION", "JAILBREAK", "RESPONSIBLE AI"),
    "SEBI-CSCRF-NET-03": ("MALICIOUS", "PHISHING", "URI"),
}

_SCHEMA = (
    "framework string, control_id string, title string, reference string, "
    "requirement string, target_entities array<string>"
)


def controls_frame(spark: SparkSession, framework: str = "ALL") -> DataFrame:
    """Controls of ALL, RBI, SEBI or DPDP (which lists none), one row each."""
    wanted = framework.upper()
    if wanted != "ALL" and wanted not in CONTROLS:
        raise ValueError(f"framework must be ALL or one of {tuple(CONTROLS)}")
    rows = [
        (group, cid, title, reference, requirement, list(targets))
        for group, controls in CONTROLS.items()
        if wanted in ("ALL", group)
        for cid, (title, reference, requirement, targets) in controls.items()
    ]
    return spark.createDataFrame(rows, _SCHEMA)


def _mapped(violations: str, words: dict[str, tuple[str, ...]]) -> str:
    """Sorted ids of the controls that some violation brings in."""
    picks = ", ".join(
        f"if(exists({violations}, v -> rlike(upper(v), {lit('|'.join(ws))})), {lit(cid)}, NULL)"
        for cid, ws in words.items()
    )
    return f"array_sort(array_compact(array({picks})))"


def map_controls_rbi(violations: str) -> str:
    return _mapped(violations, RBI_WORDS)


def map_controls_sebi(violations: str) -> str:
    return _mapped(violations, SEBI_WORDS)


def control_lookup(df: DataFrame, control_id: str = "control_id") -> DataFrame:
    """Add title, reference and requirement; null for an unknown id.

    The catalog has eight rows whatever the data, so it is broadcast.
    """
    catalog = controls_frame(df.sparkSession).select("control_id", "title", "reference", "requirement")
    return df.join(F.broadcast(catalog.withColumnRenamed("control_id", control_id)), control_id, "left")


def control_coverage(
    df: DataFrame, framework: str = "ALL", spans: str = "spans", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Detections per control, controls with none included; an entity may serve several."""
    found = detections_rollup(df, ["key"], spans=spans, options=options)
    targets = controls_frame(df.sparkSession, framework).select(
        "framework", "control_id", "title", F.explode("target_entities").alias("entity_type")
    )
    # Both sides are at most a few dozen rows: one per kind, one per target.
    return (
        targets.join(F.broadcast(found), "entity_type", "left")
        .groupBy("framework", "control_id", "title")
        .agg(
            F.coalesce(F.sum("n_spans"), F.lit(0)).alias("n_spans"),
            F.count("*").alias("n_targets"),
        )
    )
