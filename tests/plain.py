"""The rules in plain Python, written for comparison with the Spark operators."""

from __future__ import annotations

import hashlib
import json
import re

from idcordon.functions.catalog import ENTITIES, SEVERITY_RANK


def raw_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, catalog place, rank) of every hit, unchecked."""
    found = []
    for place, entity in enumerate(ENTITIES):
        for hit in re.finditer(entity.pattern, text):
            group = 1 if entity.context and hit.group(1) else 0
            found.append((hit.start(group), hit.end(group), place, SEVERITY_RANK[entity.severity]))
    return found


def resolve(spans):
    """Walk from the left; a later hit wins over the one it overlaps when it is better."""
    kept = []
    for span in sorted(spans, key=lambda s: (s[0], s[0] - s[1], -s[3], s[2])):
        if not kept or span[0] >= kept[-1][1]:
            kept.append(span)
            continue
        old = kept[-1]
        if (span[3], span[1] - span[0]) > (old[3], old[1] - old[0]) and span[3] >= old[3]:
            kept[-1] = span
    return kept


def verhoeff_ok(digits: str) -> bool:
    """Multiply permuted digits in the dihedral group, as permutations of a pentagon's corners."""
    def element(n):
        return [(i + n) % 5 if n < 5 else (n - i) % 5 for i in range(5)]

    names = {tuple(element(n)): n for n in range(10)}
    power = [list(range(10))]
    for _ in range(7):
        power.append([[1, 5, 7, 6, 2, 8, 3, 0, 9, 4][d] for d in power[-1]])
    total = 0
    for i, ch in enumerate(reversed(digits)):
        a, b = element(total), element(power[i % 8][int(ch)])
        total = names[tuple(a[b[j]] for j in range(5))]
    return total == 0


def luhn_ok(digits: str) -> bool:
    pairs = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in pairs) % 10 == 0


def record_hash(event: dict, link: str, salt: str) -> str:
    keys = ("event_id", "timestamp_utc", "conversation_id", "step_idx", "hook_name", "decision",
            "risk_score", "detected_violations")
    body = {k: event[k] for k in keys} | {"prev_event_hash": link, "salt": salt}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
