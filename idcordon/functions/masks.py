"""One mask per kind of identifier; a value of unexpected length gives a fixed token."""

from __future__ import annotations

from collections.abc import Callable

from idcordon.functions.sql import choose, let, lit
from idcordon.functions.text import drop_chars, left, right, strip


def _ends(head: int, middle: str, tail: int) -> str:
    """First characters, a fixed middle, last characters of ``m``."""
    return f"concat({left('m', head)}, {lit(middle)}, {right('m', tail)})"


def _tail(fixed: str, tail: int = 4) -> str:
    return f"concat({lit(fixed)}, {right('m', tail)})"


def _guarded(prepared: str, test: str, shape: str, token: str) -> str:
    return let(prepared, "m", choose((test, shape), otherwise=lit(token)))


def _address(value: str) -> str:
    user = "substring(m, 1, instr(m, '@') - 1)"
    shown = choose((f"length({user}) > 2", left("m", 2)), otherwise="''")
    shape = f"concat({shown}, '***@', substring(m, instr(m, '@') + 1))"
    return _guarded(value, "instr(m, '@') > 0", shape, "[REDACTED_UPI]")


# The masks and the tokens used when a value has another length.
_MASKS: dict[str, Callable[[str], str]] = {
    "AADHAAR": lambda v: _guarded(
        drop_chars(v, "-"), "length(m) >= 4", _tail("XXXX-XXXX-"), "XXXX-XXXX-XXXX"
    ),
    "PAN": lambda v: _guarded(v, "length(m) = 10", _ends(2, "XXXXX", 3), "[REDACTED_PAN]"),
    "PASSPORT_IN": lambda v: _guarded(
        v, "length(m) >= 2", _ends(1, "XXXXXX", 1), "[REDACTED_PASSPORT]"
    ),
    "VOTER_ID_IN": lambda v: _guarded(
        v, "length(m) = 10", _ends(3, "XXXX", 3), "[REDACTED_VOTER_ID]"
    ),
    "DRIVING_LICENSE_IN": lambda v: _guarded(
        v, "length(m) >= 6", _ends(2, "XXXX", 4), "[REDACTED_DL]"
    ),
    "GSTIN": lambda v: _guarded(v, "length(m) = 15", _ends(2, "XXXXXXXXX", 4), "[REDACTED_GSTIN]"),
    "BANK_ACCOUNT_IN": lambda v: _guarded(
        drop_chars(v, "-"), "length(m) >= 4", _tail("XXXXXXXXXXXX"), "[REDACTED_ACCOUNT]"
    ),
    "IFSC": lambda v: _guarded(v, "length(m) = 11", _ends(4, "0XX", 3), "[REDACTED_IFSC]"),
    "MICR": lambda v: _guarded(v, "length(m) = 9", _ends(3, "XXX", 3), "[REDACTED_MICR]"),
    "UPI_VPA": _address,
    "CREDIT_DEBIT_CARD": lambda v: _guarded(
        drop_chars(v, "-"), "length(m) >= 8", _ends(4, "-XXXX-XXXX-", 4), "[REDACTED_CARD]"
    ),
    "CARD_CVV": lambda v: lit("[REDACTED_CVV]"),
    "PHONE_IN": lambda v: _guarded(
        drop_chars(v, "()+-"), "length(m) >= 4", _tail("+91-XXXXX-"), "[REDACTED_PHONE]"
    ),
    "PIN_CODE_IN": lambda v: _guarded(
        drop_chars(v, ""), "length(m) = 6", f"concat({left('m', 3)}, 'XXX')", "[REDACTED_PIN]"
    ),
    "CIN_IN": lambda v: _guarded(v, "length(m) = 21", _ends(6, "XXXXXXXX", 7), "[REDACTED_CIN]"),
}


def mask(entity_key: str, value: str) -> str:
    """Mask values that are all of one kind."""
    shape = _MASKS.get(entity_key)
    return shape(strip(value)) if shape else lit(f"[REDACTED_{entity_key}]")


def mask_by_type(entity: str, value: str) -> str:
    """Mask values whose kind stands in another column."""
    return choose(
        *[(f"{entity} = {lit(key)}", mask(key, value)) for key in _MASKS],
        otherwise=f"concat('[REDACTED_', {entity}, ']')",
    )
