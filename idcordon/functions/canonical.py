"""The text that an audit hash is taken of: JSON with sorted keys and ASCII only."""

from __future__ import annotations

from idcordon.functions.sql import choose, let, lit
from idcordon.functions.text import py_float


def json_string(text: str) -> str:
    """A JSON string; everything but printable ASCII is written as ``\\uXXXX``."""
    unit = r"concat('\\u', lpad(lower(hex({0})), 4, '0'))".format
    over = "(ascii(c) - 65536)"
    escaped = choose(
        ("c = '\"'", "'\\\\\"'"),
        (r"c = '\\'", r"'\\\\'"),
        (r"c = '\n'", r"'\\n'"),
        (r"c = '\r'", r"'\\r'"),
        (r"c = '\t'", r"'\\t'"),
        ("ascii(c) = 8", r"'\\b'"),
        ("ascii(c) = 12", r"'\\f'"),
        ("ascii(c) BETWEEN 32 AND 126", "c"),
        (
            "ascii(c) > 65535",
            f"concat({unit(f'55296 + {over} div 1024')}, {unit(f'56320 + {over} % 1024')})",
        ),
        otherwise=unit("ascii(c)"),
    )
    return let(
        text,
        "t",
        "concat('\"', if(rlike(t, r'[^ !#-\\[\\]-~]'), "
        f"array_join(transform(split(t, ''), c -> {escaped}), ''), t), '\"')",
    )


def _key(name: str) -> str:
    return f'"{name}": '


def _or_null(json: str) -> str:
    return f"coalesce({json}, 'null')"


def hash_parts(salt: str) -> tuple[str, str]:
    """What stands before and after the link in the hashed text, over the columns of an event.

    A null field, list or list item is written as ``null``, so neither part is ever null.
    """
    violations = (
        f"concat('[', array_join(transform(detected_violations, w -> {_or_null(json_string('w'))}), ', '), ']')"
    )
    head = ", ".join(
        [
            "'{" + _key("conversation_id") + "'", _or_null(json_string("conversation_id")),
            f"', {_key('decision')}'", _or_null(json_string("decision")),
            f"', {_key('detected_violations')}'", _or_null(violations),
            f"', {_key('event_id')}'", _or_null(json_string("event_id")),
            f"', {_key('hook_name')}'", _or_null(json_string("hook_name")),
            f"', {_key('prev_event_hash')}\"'",
        ]
    )
    tail = ", ".join(
        [
            f"'\", {_key('risk_score')}'", _or_null(py_float("risk_score")),
            f"', {_key('salt')}'", json_string(lit(salt)),
            f"', {_key('step_idx')}'", _or_null("cast(step_idx AS string)"),
            f"', {_key('timestamp_utc')}'", _or_null(json_string("timestamp_utc")),
            "'}'",
        ]
    )
    return f"concat({head})", f"concat({tail})"


def event_hash(salt: str, link: str = "prev_event_hash") -> str:
    """SHA-256 of an event whose previous hash is ``link``."""
    head, tail = hash_parts(salt)
    return f"sha2(concat({head}, {link}, {tail}), 256)"
