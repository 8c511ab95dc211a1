"""Pieces of Spark SQL text.

The functions of this package take and give SQL expressions as text, so that a scan of
fifteen kinds reaches the JVM as a few ``expr`` calls instead of thousands of column
calls. ``F.expr(card("number"))`` is a column like any other.
"""

from __future__ import annotations


def lit(value: str | int | float | bool | None) -> str:
    """A literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(regex: str) -> str:
    """A regex literal; a backslash stands for itself."""
    if "'" in regex:
        return lit(regex)
    return f"r'{regex}'"


def name(column: str) -> str:
    """A column name, quoted."""
    return "`" + column.replace("`", "``") + "`"


def array(values) -> str:
    return f"array({', '.join(lit(v) for v in values)})"


def empty(element_type: str) -> str:
    return f"cast(array() AS array<{element_type}>)"


def let(value: str, var: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``var`` inside ``body``."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def once(value: str, alias: str) -> str:
    """A select item that is evaluated exactly once per row.

    The optimizer likes to copy an expression into every filter and projection above it,
    which for a regex pass or a fold costs more than it saves. It does not look through
    a generator, and ``explode`` of a one-item array gives one row for one row.
    """
    return f"explode(array({value})) AS {alias}"


def choose(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN {test} THEN {value}" for test, value in branches)
    return f"CASE {cases} ELSE {otherwise} END"


_BLOCK = 256


def fold_emit(
    items: str,
    carry: str,
    out_type: str,
    step_carry: str,
    step_out: str,
    finish: str | None = None,
) -> str:
    """Walk an array in order, hand a value from item to item, collect what is given off.

    ``step_carry`` is written over the value handed on, ``a.carry``, and the item ``x``;
    ``step_out`` (an array) may also use the new value, ``n``; ``finish`` (an array) is
    written over ``s.carry``. Growing one long array by single appends would copy it
    each time, so short arrays are filled by block and then joined.
    """
    none = empty(out_type)
    start = f"named_struct('carry', {carry}, 'out', {none})"
    step = let(step_carry, "n", f"named_struct('carry', n, 'out', concat(a.out, {step_out}))")
    inner = (
        f"aggregate(slice(xs, k * {_BLOCK} + 1, {_BLOCK}), "
        f"named_struct('carry', s.carry, 'out', {none}), (a, x) -> {step})"
    )
    block = let(inner, "b", "named_struct('carry', b.carry, 'out', concat(s.out, b.out))")
    last = f"concat(s.out, {finish})" if finish else "s.out"
    walk = (
        f"aggregate(sequence(0, cast((size(xs) - 1) div {_BLOCK} AS int)), {start}, "
        f"(s, k) -> {block}, s -> {last})"
    )
    return let(items, "xs", choose(("size(xs) > 0", walk), otherwise=none))
