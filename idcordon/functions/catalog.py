"""The identifier catalog: what is looked for, how grave it is, who regulates it."""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Entity:
    """One kind of identifier.

    ``check`` names a rule of :mod:`idcordon.functions.validators`; ``None`` accepts
    every hit. With ``context`` the identifier is capture group 1 when that group took
    part. ``gate`` is a cheap pattern that every text with a hit must meet; ``None``
    means that the full pattern is tried on every text. ``lead`` is a pattern that every
    hit starts with, tested first at each place; it changes the cost, not the hits.
    """

    key: str
    name: str
    category: str
    severity: str
    frameworks: tuple[str, ...]
    pattern: str
    check: str | None = None
    context: bool = False
    gate: str | None = None
    lead: str | None = None


# Severities from grave to slight, with their ranks.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

# Identifier categories.
CATEGORIES = (
    "NATIONAL_ID",
    "TAX_AND_FINANCIAL_ID",
    "BANKING_DATA",
    "CARD_DATA",
    "AUTHENTICATION_DATA",
    "PAYMENT_IDENTIFIER",
    "CONTACT_INFO",
    "TRAVEL_DOCUMENT",
    "LOCATION_DATA",
    "CORPORATE_IDENTIFIER",
)

# Gates. Each is implied by the patterns that name it: a run of seven digits with at
# most one separator; four digits before a capital; three digits; the bank-code head.
_LONG_NUMBER = r"\d{3}[\s-]?\d{4}|\d{2}\s?\d{5}"
_DIGITS_CAPITAL = r"\d{4}[A-Z]"
_THREE_DIGITS = r"\d{3}"
_BANK_CODE = r"[A-Z]{4}0"
_AT_SIGN = "@"

# Names, categories, severities, frameworks and patterns of the fifteen
# identifiers, in the order that settles ties between overlapping hits.
ENTITIES: tuple[Entity, ...] = (
    Entity(
        "AADHAAR", "Aadhaar Number (UIDAI)", "NATIONAL_ID", "CRITICAL",
        ("RBI_MD_IT_2023", "SEBI_CSCRF_2024", "DPDP_ACT_2023", "UIDAI_REGULATIONS"),
        r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b",
        check="aadhaar", gate=_LONG_NUMBER, lead=r"[2-9]",
    ),
    Entity(
        "PAN", "Permanent Account Number (PAN)", "TAX_AND_FINANCIAL_ID", "CRITICAL",
        ("RBI_MD_IT_2023", "SEBI_CSCRF_2024", "DPDP_ACT_2023", "INCOME_TAX_ACT"),
        r"\b[A-Z]{3}[PCHFATBLJG][A-Z]\d{4}[A-Z]\b",
        check="pan", gate=_DIGITS_CAPITAL, lead=r"[A-Z]",
    ),
    Entity(
        "PASSPORT_IN", "Indian Passport Number", "TRAVEL_DOCUMENT", "HIGH",
        ("RBI_MD_IT_2023", "SEBI_CSCRF_2024", "DPDP_ACT_2023"),
        r"\b[A-PR-WYa-pr-wy][1-9]\d\s?\d{4}[1-9]\b",
        check="passport", gate=_LONG_NUMBER, lead=r"[A-PR-WYa-pr-wy][1-9]",
    ),
    Entity(
        "VOTER_ID_IN", "Election Photo Identity Card (Voter ID / EPIC)", "NATIONAL_ID", "HIGH",
        ("DPDP_ACT_2023", "RBI_KYC_DIRECTIONS"),
        r"\b[A-Z]{3}\d{7}\b",
        gate=_LONG_NUMBER, lead=r"[A-Z]",
    ),
    Entity(
        "DRIVING_LICENSE_IN", "Indian Driving Licence (DL)", "NATIONAL_ID", "HIGH",
        ("DPDP_ACT_2023", "RBI_KYC_DIRECTIONS"),
        r"\b(?:[A-Z]{2}[-\s]?\d{2}[-\s]?(?:19|20)\d{2}[-\s]?\d{7}|[A-Z]{2}\d{13,14})\b",
        check="driving_licence", gate=_LONG_NUMBER, lead=r"[A-Z]",
    ),
    Entity(
        "GSTIN", "Goods and Services Tax Identification Number (GSTIN)",
        "TAX_AND_FINANCIAL_ID", "HIGH",
        ("SEBI_CSCRF_2024", "RBI_MD_IT_2023", "GST_ACT_2017"),
        r"\b(?:0[1-9]|[1-2]\d|3[0-8]|97|99)[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",
        check="gstin", gate=_DIGITS_CAPITAL, lead=r"[0-39]",
    ),
    Entity(
        "BANK_ACCOUNT_IN", "Indian Bank Account Number", "BANKING_DATA", "CRITICAL",
        ("RBI_MD_IT_2023", "RBI_CYBER_SECURITY_FRAMEWORK", "SEBI_CSCRF_2024"),
        r"(?i)(?:a\/?c|account(?:\s*no|\s*number)?|acc\s*no|saving(?:s)?\s*a\/?c|current\s*a\/?c|salary\s*a\/?c)[\s:=#-]*(\d{9,18})\b",
        check="account", context=True, gate=_LONG_NUMBER, lead=r"[acs]",
    ),
    Entity(
        "IFSC", "Indian Financial System Code (IFSC)", "BANKING_DATA", "MEDIUM",
        ("RBI_MD_IT_2023", "NPCI_GUIDELINES"),
        r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
        check="ifsc", gate=_BANK_CODE, lead=r"[A-Z]",
    ),
    Entity(
        "MICR", "Magnetic Ink Character Recognition (MICR) Code", "BANKING_DATA", "MEDIUM",
        ("RBI_MD_IT_2023", "CTS_REGULATIONS"),
        r"(?i)(?:micr(?:\s*code)?[\s:=#-]*)\b(\d{9})\b|\b(\d{3}\d{3}\d{3})\b(?=\s*(?:cheque|clearing|micr))",
        context=True, gate=_LONG_NUMBER, lead=r"[m\d]",
    ),
    Entity(
        "UPI_VPA", "Unified Payments Interface Virtual Payment Address (UPI VPA)",
        "PAYMENT_IDENTIFIER", "HIGH",
        ("RBI_DIGITAL_PAYMENT_2021", "NPCI_UPI_SECURITY_CIRCULARS", "DPDP_ACT_2023"),
        r"\b[a-zA-Z0-9._-]{2,64}@(?:okaxis|okicici|oksbi|okhdfcbank|paytm|ybl|ibl|axl|apl|upi|postbank|barodampay|federal|kotak|indus|pnb|allbank|cnrb|sbi|aubank|idbi|boi|unionbank|equitas|fbl|rbl|pingpay|slice|jupiteraxis|cred|freecharge|mobikwik|amazonpay|airtel)\b|\b[a-zA-Z0-9._-]{3,64}@[a-zA-Z]{3,30}\b",
        check="upi", gate=_AT_SIGN, lead=r"[a-zA-Z0-9._-]{2,64}+@",
    ),
    Entity(
        "CREDIT_DEBIT_CARD", "Payment Card Number (RuPay / Visa / Mastercard / Amex)",
        "CARD_DATA", "CRITICAL",
        ("RBI_TOKENIZATION_CIRCULAR", "RBI_CARD_DATA_SECURITY", "PCI_DSS_V4"),
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12}|(?:508[5-9]|606[9]|607[0-9]|608[0-4]|652[1-2]|653[0-1])[0-9]{12}|3[47][0-9]{13})\b",
        check="card", gate=_LONG_NUMBER, lead=r"[3-6]",
    ),
    Entity(
        "CARD_CVV", "Card Verification Value (CVV / CVC / CID)", "AUTHENTICATION_DATA", "CRITICAL",
        ("RBI_TOKENIZATION_CIRCULAR", "PCI_DSS_V4"),
        r"(?i)\b(?:cvv|cvc|cid|security\s*code|card\s*verification)[\s:=#-]*([0-9]{3,4})\b",
        context=True, gate=_THREE_DIGITS, lead=r"[cs]",
    ),
    Entity(
        "PHONE_IN", "Indian Mobile / Telephone Number", "CONTACT_INFO", "MEDIUM",
        ("DPDP_ACT_2023", "TRAI_REGULATIONS", "RBI_MD_IT_2023"),
        r"(?:\+91[\s-]?)?(?:\(?0?[6-9]\d{2}\)?[\s-]?)?\d{3}[\s-]?\d{4}\b",
        check="phone", gate=_LONG_NUMBER, lead=r"[+(\d]",
    ),
    Entity(
        "PIN_CODE_IN", "Postal Index Number (PIN Code)", "LOCATION_DATA", "LOW",
        ("DPDP_ACT_2023",),
        r"(?i)(?:pin(?:\s*code)?|postal(?:\s*code)?|zip)[\s:=#-]*\b([1-9]\d{2}\s?\d{3})\b",
        check="pin_code", context=True, gate=_THREE_DIGITS, lead=r"[pz]",
    ),
    Entity(
        "CIN_IN", "Corporate Identification Number (CIN)", "CORPORATE_IDENTIFIER", "MEDIUM",
        ("SEBI_LODR_REGULATIONS", "MCA_REGULATIONS"),
        r"\b([LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b",
        check="cin", gate=_DIGITS_CAPITAL, lead=r"[LU]",
    ),
)

# Checksum rules as a catalog file names them, and this package's rule.
# A name that is not listed accepts every hit.
CHECKSUM_RULES = {
    "verhoeff": "aadhaar",
    "luhn": "card",
    "gstin_mod36": "gstin",
    "pan_structure": "pan",
    "ifsc_structure": "ifsc",
    "upi_handle_validation": "upi",
    "phone_in_validation": "phone",
    "dl_in_structure": "driving_licence",
    "passport_in_structure": "passport",
    "cin_structure": "cin",
    "pin_code_validation": "pin_code",
    "contextual_digits": "account",
}

BY_KEY = {entity.key: entity for entity in ENTITIES}

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("entity_ord", T.LongType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField("entity_name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("severity_rank", T.LongType(), False),
        T.StructField("frameworks", T.ArrayType(T.StringType()), False),
    ]
)


def without(allowed: tuple[str, ...] | list[str], entities: tuple[Entity, ...] = ENTITIES):
    """The catalog without the identifiers on an allow list; they are never searched."""
    skip = set(allowed)
    return tuple(entity for entity in entities if entity.key not in skip)


def catalog_frame(spark: SparkSession, entities: tuple[Entity, ...] = ENTITIES) -> DataFrame:
    """The catalog as a table, one row per identifier."""
    rows = [
        (i, e.key, e.name, e.category, e.severity, SEVERITY_RANK[e.severity], list(e.frameworks))
        for i, e in enumerate(entities)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def ends_with_its_group(regex: str) -> bool:
    """Whether group 1, where it takes part, ends where the hit ends: behind it only tests of width zero."""
    depth, start, stack, in_class, i = 0, None, [], False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += regex[i + 1 : i + 2] in ("]", "^")
        elif c == "(":
            named = regex.startswith("(?P<", i) or re.match(r"\(\?<[A-Za-z]", regex[i:])
            capturing = not regex.startswith("(?", i) or bool(named)
            stack.append(i if capturing and start is None else None)
            if capturing and start is None:
                start, depth = i, len(stack)
        elif c == ")":
            if stack.pop() is not None:
                rest = regex[i + 1 :]
                return depth == 1 and re.match(r"(\\b|\\B|\$|\(\?<?[!=][^()]*\))*(\||\Z)", rest) is not None
        i += 1
    return start is None


def load_catalog(spark: SparkSession, path: str) -> tuple[Entity, ...]:
    """Read a catalog file: ``{"entities": {key: {name, category, severity, ...}}}``.

    Entries without a pattern are skipped; a missing file is an error. So is a pattern of an
    identifier with context whose group 1 isn't the end of the hit: its place could not be told
    from the hit's end, and digits before it would stay in the redacted text. The catalog is
    small by nature (one entry per kind of identifier) and shapes the plan, so it is
    read on the driver.
    """
    entry = (
        "struct<name:string,category:string,severity:string,"
        "regulatory_frameworks:array<string>,regex:string,checksum_algorithm:string>"
    )
    frame = (
        spark.read.option("multiLine", True)
        .schema(f"entities map<string,{entry}>")
        .json(path)
        .selectExpr("posexplode(map_entries(entities)) as (pos, entity)")
        .orderBy("pos")
    )
    loaded = []
    for row in frame.collect():
        key, spec = row["entity"]["key"], row["entity"]["value"]
        if not spec["regex"]:
            continue
        known = BY_KEY.get(key)
        same = known is not None and known.pattern == spec["regex"]
        category = spec["category"] or "NATIONAL_ID"
        severity = spec["severity"] or "HIGH"
        if category not in CATEGORIES or severity not in SEVERITY_RANK:
            raise ValueError(f"{key}: unknown category or severity")
        if known and known.context and not same and not ends_with_its_group(spec["regex"]):
            raise ValueError(f"{key}: the capture group must end the pattern")
        loaded.append(
            Entity(
                key,
                spec["name"] or key,
                category,
                severity,
                tuple(spec["regulatory_frameworks"] or ()),
                spec["regex"],
                check=CHECKSUM_RULES.get(spec["checksum_algorithm"] or ""),
                context=bool(known and known.context),
                gate=known.gate if same else None,
                lead=known.lead if same else None,
            )
        )
    return tuple(loaded)
