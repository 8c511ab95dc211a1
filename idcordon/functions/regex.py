"""Catalog patterns are written with Python's meaning; Spark runs them on the JVM.

The two differ in three ways, all of which matter for Indic texts:

* digits, spaces and case must be Unicode-aware: flag ``U`` on the JVM;
* a Python word character is a letter, a number or ``_``, while the JVM also counts
  combining marks (vowel signs), so ``\\b`` is spelled out with look-arounds;
* Python counts four information separators as space.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f]"
_BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def jvm_pattern(pattern: str, lead: str | None = None, gaps: bool = False) -> str:
    """A JVM pattern with the hits that ``pattern`` has in Python.

    ``lead`` is something that every hit starts with, tested before the rest.
    With ``gaps`` a hit also takes in the text since the hit before, as group 1; groups
    of ``pattern`` move up by one.
    """
    flags, first = "U", f"(?={lead})" if lead else ""
    if pattern.startswith("(?i)"):
        flags, pattern = "iU", pattern[len("(?i)"):]
    spelled = re.sub(
        r"\\(.)",
        lambda m: {"b": _BOUNDARY, "s": SPACE}.get(m.group(1), m.group(0)),
        pattern,
    )
    if gaps:
        return rf"(?{flags})\G(?s:(.*?))(?:{first}(?:{spelled}))"
    return f"(?{flags}){first}(?:{spelled})"
