"""From events to the text that is scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.functions.sql import array, choose, let, lit, name
from idcordon.functions.text import is_blank, py_float

# Tool arguments that hold text, in the order in which they are joined,
# and keys of an event that may hold a prompt, in the order in which they are tried.
TEXT_ARGS = (
    "CommandLine", "CodeContent", "Content", "TargetContent",
    "ReplacementContent", "Query", "Message", "Prompt",
)
PROMPT_KEYS = ("prompt", "userPrompt", "content", "userMessage")


def _as_text(variant: str) -> str:
    """A scalar as Python prints it; objects and lists as JSON; null for an absent key."""
    return let(
        variant,
        "v",
        choose(
            ("v IS NULL", "NULL"),
            ("schema_of_variant(v) = 'VOID'", "'None'"),
            ("schema_of_variant(v) = 'BOOLEAN'", "if(variant_get(v, '$', 'boolean'), 'True', 'False')"),
            # Whole numbers beyond 64 bits keep their digits.
            ("schema_of_variant(v) LIKE 'DECIMAL(%,0)'", "variant_get(v, '$', 'string')"),
            (
                "schema_of_variant(v) LIKE 'DECIMAL%' OR schema_of_variant(v) = 'DOUBLE'",
                let("variant_get(v, '$', 'double')", "d", py_float("d")),
            ),
            (
                "schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'",
                "to_json(v)",
            ),
            otherwise="variant_get(v, '$', 'string')",
        ),
    )


def latest_user_prompt(transcripts: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The last non-empty user input of each conversation; one partial row per task and key."""
    user = (F.col("type") == "USER_INPUT") | (F.col("source") == "USER_EXPLICIT")
    return (
        transcripts.where(user & (F.col("content") != ""))
        .groupBy(key)
        .agg(F.max_by("content", "line_no").alias("latest_prompt"))
    )


def event_type(df: DataFrame, flag: str | None = None, out: str = "event_type") -> DataFrame:
    """Class of an event read by ``parse_events``; a non-null ``flag`` column wins."""
    has = "array_contains(coalesce(event_keys, array()), '{}')".format
    bare_end = (
        f"{has('invocationNum')} AND NOT {has('stepIdx')} AND coalesce(transcript_path, '') = ''"
    )
    kind = choose(
        (has("toolCall"), "'pre_tool_use'"), (bare_end, "'post_invocation'"),
        otherwise="'pre_invocation'",
    )
    if flag:
        kind = f"coalesce(lower(trim({name(flag)})), {kind})"
    return df.select("*", F.expr(kind).alias(out))


def conversation_key(conversation: str) -> str:
    """Letters, digits, ``-`` and ``_`` of an id; ``default`` when none are left."""
    kept = rf"regexp_replace({conversation}, r'[^\p{{L}}\p{{N}}_-]', '')"
    return let(kept, "c", choose(("c IS NULL OR c IN ('', 'unknown')", "'default'"), otherwise="c"))


def extract_text(
    events: DataFrame, prompts: DataFrame | None = None, payload: str = "payload"
) -> DataFrame:
    """Add ``scan_text`` and ``text_source`` to events read by ``parse_events``.

    Tried in order: named tool arguments, all scalar tool arguments, the latest user
    prompt of the transcript (``prompts``: transcript_path, latest_prompt), keys of the event.
    """
    args = "try_variant_get(event, '$.toolCall.args', 'map<string,variant>')"
    # A variant sorts its keys; the JSON text keeps the order of the document.
    order = (
        f"array_union(coalesce(json_object_keys(get_json_object({name(payload)}, '$.toolCall.args')), array()), "
        f"coalesce(map_keys({args}), array()))"
    )
    strings = (
        f"array_join(filter(transform({array(TEXT_ARGS)}, k -> "
        "if(schema_of_variant(try_element_at(_args, k)) = 'STRING', "
        "variant_get(try_element_at(_args, k), '$', 'string'), NULL)), "
        "t -> t IS NOT NULL AND t <> ''), '\\n')"
    )
    scalar = (
        "schema_of_variant(try_element_at(_args, k)) IN ('STRING', 'BIGINT', 'BOOLEAN', 'DOUBLE') "
        "OR schema_of_variant(try_element_at(_args, k)) LIKE 'DECIMAL%'"
    )
    everything = (
        f"transform(filter(_order, k -> {scalar}), k -> {_as_text('try_element_at(_args, k)')})"
    )
    first_key = f"get(filter({array(PROMPT_KEYS)}, k -> array_contains(event_keys, k)), 0)"
    direct = choose(
        *[
            (f"_key = {lit(k)}", _as_text(f"try_variant_get(event, '$.{k}', 'variant')"))
            for k in PROMPT_KEYS
        ]
    )
    # All that needs the event is taken out first, so that only the texts are joined.
    read = events.selectExpr(
        "*", f"{args} AS _args", f"{order} AS _order", f"{first_key} AS _key"
    ).selectExpr(
        "*",
        f"{strings} AS _named",
        f"{everything} AS _all",
        f"{direct} AS _direct",
        # Events without a transcript must not all meet in one partition of the join.
        f"coalesce(nullif(transcript_path, ''), concat('none:', hex(xxhash64({name(payload)})))) AS _path",
    )
    if prompts is None:
        joined = read.selectExpr("*", "cast(NULL AS string) AS latest_prompt")
    else:
        # One text for each conversation: too much for a broadcast, though it is guessed to be small.
        latest = prompts.selectExpr("transcript_path AS _path", "latest_prompt").hint("merge")
        joined = read.join(latest, "_path", "left")
    from_transcript = "transcript_path <> '' AND latest_prompt <> ''"
    return joined.selectExpr(
        *[name(c) for c in events.columns],
        choose(
            ("_named <> ''", "_named"),
            ("size(_all) > 0", "array_join(_all, ' ')"),
            (from_transcript, "latest_prompt"),
            ("_key IS NOT NULL", "_direct"),
            otherwise="''",
        )
        + " AS scan_text",
        choose(
            ("_named <> ''", "concat('tool_args:', coalesce(tool_name, 'None'))"),
            ("size(_all) > 0", "concat('tool_args_all:', coalesce(tool_name, 'None'))"),
            (from_transcript, "'transcript:user_input'"),
            ("_key IS NOT NULL", "concat('payload:', _key)"),
            otherwise="'empty'",
        )
        + " AS text_source",
    )


def skip_empty(df: DataFrame, text_col: str = "scan_text", out: str = "skipped") -> DataFrame:
    """Mark texts that are let through unscanned: null, empty or blank."""
    return df.select("*", F.expr(is_blank(name(text_col))).alias(out))
