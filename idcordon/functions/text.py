"""Small string helpers with Python's meaning of space and digit."""

from __future__ import annotations

import sys
import unicodedata

from idcordon.functions.regex import SPACE
from idcordon.functions.sql import pattern

# Decimal digits of the other scripts and the ASCII digits they stand for.
_FOREIGN = [
    chr(cp)
    for cp in range(0x80, sys.maxunicode + 1)
    if unicodedata.category(chr(cp)) == "Nd"
]
_FOREIGN_FROM = "".join(_FOREIGN)
_FOREIGN_TO = "".join(str(unicodedata.decimal(ch)) for ch in _FOREIGN)


def strip(text: str) -> str:
    """Drop space of every kind from both ends (``trim`` drops plain blanks only)."""
    edges = pattern(rf"(?U)\A{SPACE}+|{SPACE}+\z")
    return f"regexp_replace({text}, {edges}, '')"


def drop_chars(text: str, chars: str) -> str:
    """Remove space of every kind and the given characters of a regex class."""
    return f"regexp_replace({text}, {pattern(f'(?U)[{SPACE}{chars}]')}, '')"


def is_blank(text: str) -> str:
    """Null, empty or nothing but space."""
    return f"({text} IS NULL OR NOT rlike({text}, {pattern(f'(?U)[^{SPACE}]')}))"


def ascii_digits(text: str) -> str:
    """Write the digits of every script in ASCII. Only texts that need it pay for it."""
    return (
        f"CASE WHEN rlike({text}, {pattern(r'(?U)(?![0-9])\d')}) "
        f"THEN translate({text}, '{_FOREIGN_FROM}', '{_FOREIGN_TO}') ELSE {text} END"
    )


def left(text: str, n: int) -> str:
    return f"left({text}, {n})"


def right(text: str, n: int) -> str:
    """The last ``n`` characters, or the whole text when it is shorter."""
    return f"right({text}, {n})"


def py_float(value: str) -> str:
    """A double as Python prints it, for magnitudes from 0.001 up to 1e16."""
    digits = f"regexp_replace(cast(cast({value} AS decimal(38,18)) AS string), '0+$', '')"
    return (
        f"CASE WHEN abs({value}) >= 1e7 AND abs({value}) < 1e16 "
        f"THEN regexp_replace({digits}, '[.]$', '.0') ELSE cast({value} AS string) END"
    )
