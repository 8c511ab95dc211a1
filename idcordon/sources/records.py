"""Readers of JSON events, transcripts, filter answers and audit trails."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idcordon.functions.sql import name, once
from idcordon.sources.shared import stored

# Keys of an event in JSON.
_EVENT = "struct<name:string,args:string>"

# Answers of the safety filter, in either spelling of their keys.
_STATES = "matchState:string,match_state:string"
_LEVELS = f"{_STATES},confidenceLevel:string,confidence_level:string"
_FINDINGS = "array<struct<infoType:string,info_type:string>>"
_INJECTION = f"struct<{_LEVELS},score:string>"
_RAI = (
    f"struct<{_STATES},raiFilterTypeResults:map<string,struct<{_LEVELS}>>,"
    f"rai_filter_type_results:map<string,struct<{_LEVELS}>>>"
)
_INSPECT = f"struct<{_STATES},findings:{_FINDINGS}>"
_SDP = f"struct<inspectResult:{_INSPECT},inspect_result:{_INSPECT}>"
_URIS = f"struct<{_STATES},matchedUris:array<string>,matched_uris:array<string>>"
_STATE_ONLY = f"struct<{_STATES}>"


def _both(camel: str, snake: str, kind: str) -> str:
    return f"struct<{camel}:{kind},{snake}:{kind}>"


_FILTERS = (
    "struct<"
    f"pi_and_jailbreak:{_both('piAndJailbreakFilterResult', 'pi_and_jailbreak_filter_result', _INJECTION)},"
    f"rai:{_both('raiFilterResult', 'rai_filter_result', _RAI)},"
    f"sdp:{_both('sdpFilterResult', 'sdp_filter_result', _SDP)},"
    f"malicious_uris:{_both('maliciousUriFilterResult', 'malicious_uri_filter_result', _URIS)},"
    f"csam:{_both('csamFilterFilterResult', 'csam_filter_filter_result', _STATE_ONLY)}>"
)
_RESULT = (
    "struct<filterMatchState:string,filter_match_state:string,"
    "invocationResult:string,invocation_result:string,"
    f"filterResults:{_FILTERS},filter_results:{_FILTERS}>"
)
RESPONSE_SCHEMA = f"sanitizationResult {_RESULT}, sanitization_result {_RESULT}"

AUDIT_SCHEMA = (
    "event_id string, timestamp_utc string, timestamp_ist string, conversation_id string, "
    "step_idx bigint, hook_name string, event_type string, decision string, reason string, "
    "risk_score double, detected_violations array<string>, masked_entities array<struct<"
    "entity_type:string,entity_name:string,category:string,severity:string,"
    "masked_value:string,start_index:bigint,end_index:bigint,confidence:double,"
    "checksum_valid:boolean,regulatory_frameworks:array<string>>>, "
    "regulatory_frameworks array<string>, caller_metadata map<string,string>, "
    "prev_event_hash string, event_hash string"
)


_REPEATED = "spark.sql.variant.allowDuplicateKeys"


def prepare(spark: SparkSession) -> SparkSession:
    """Set a session up for reading events and transcripts; call it once for each session.

    JSON with a key twice in one object is then read, and the last one counts, as in most readers; Spark's
    parser calls such JSON unreadable otherwise. The setting must stand when a plan runs.
    """
    spark.conf.set(_REPEATED, "true")
    return spark


def _prepared(spark: SparkSession) -> None:
    if spark.conf.get(_REPEATED, "false") != "true":
        raise ValueError("call idcordon.sources.records.prepare(spark) first")


def parse_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Read JSON events, text or bytes; absent keys get defaults, unreadable ones are all defaults.

    Bytes that are no UTF-8 become U+FFFD.

    Of a key that is repeated in one object the last one counts. Adds ``event`` (a variant, null when unreadable), ``event_keys`` and the fields.
    """
    kind = df.schema[payload].dataType.simpleString()
    df = df.withColumn(payload, F.expr(decoded(payload, kind)))
    p = name(payload)
    _prepared(df.sparkSession)
    return df.select("*", F.expr(f"try_parse_json({p})").alias("event")).selectExpr(
        "*",
        f"CASE WHEN event IS NOT NULL THEN json_object_keys({p}) END AS event_keys",
        "coalesce(try_variant_get(event, '$.conversationId', 'string'), 'unknown') AS conversation_id",
        "try_variant_get(event, '$.stepIdx', 'bigint') AS step_idx",
        "try_variant_get(event, '$.transcriptPath', 'string') AS transcript_path",
        "try_variant_get(event, '$.toolCall.name', 'string') AS tool_name",
    )


def parse_transcript_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Read transcript lines; blank and malformed ones are left out."""
    v = f"try_parse_json({name(line)})"
    _prepared(df.sparkSession)
    return (
        df.select("*", F.expr(v).alias("_step"))
        .where("_step IS NOT NULL AND schema_of_variant(_step) LIKE 'OBJECT%'")
        .selectExpr(
            *[name(c) for c in df.columns if c != line],
            "coalesce(try_variant_get(_step, '$.type', 'string'), '') AS type",
            "coalesce(try_variant_get(_step, '$.source', 'string'), '') AS source",
            "coalesce(try_variant_get(_step, '$.content', 'string'), '') AS content",
        )
    )


def decoded(column: str, kind: str) -> str:
    """Text of a column; bytes that are no UTF-8 become U+FFFD, one for each longest broken sequence."""
    return f"make_valid_utf8({f'cast({name(column)} AS string)' if kind == 'binary' else name(column)})"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number in the file, from 0: file, line_no, line.

    A file is read in blocks by many tasks. A task numbers the lines of its block as they come; the lines of the blocks before
    it, summed by file, are added. Only these sums, a row for each block, are joined. Bytes that are no UTF-8 are left out of a line.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = None, 0
        for b in batches:
            files, starts, lines = (b.column(i).to_pylist() for i in range(3))
            places = []
            for of in zip(files, starts):
                block, n = of, (n + 1 if of == block else 0)
                places.append(n)
            texts = [None if x is None else x.decode("utf-8", "ignore") for x in lines]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["file", "block", "n", "line"]
            )

    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )
    numbered = stored(read.mapInArrow(count, "file string, block bigint, n bigint, line string"), "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("file", "block").agg(F.count("*").alias("lines"))
    starts = sizes.select("file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    return numbered.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("n")).alias("line_no"), "line")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript files, one per conversation: file, line_no, type, source, content."""
    return parse_transcript_lines(read_lines(spark, path))


def parse_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Unwrap answers of the safety filter in either spelling of their keys.

    Adds ``filter_match_state``, ``invocation_result`` and ``filters``. Null states mean an
    answer that can't be relied on: no JSON, a part of another shape than
    the filter gives (a list or text instead of an object), a score that is no number. Absent keys, null and empty objects stand for the defaults.

    An answer is parsed once, by a schema that holds both spellings; the parser marks what doesn't have that shape. It
    stands inside an object with a second key, so that text behind an answer is seen too.
    """
    wrapped = f"concat('{{\"answer\":', {name(response)}, ',\"end\":1}}')"
    strict = "map('columnNameOfCorruptRecord', 'bad', 'allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"
    parsed = f"from_json({wrapped}, 'answer struct<{RESPONSE_SCHEMA.replace(' struct', ':struct')}>, `end` int, bad string', {strict})"

    def filled(s: str) -> str:
        return " OR ".join(f"{s}.{f} IS NOT NULL" for f in ("filterMatchState", "filter_match_state", "invocationResult", "invocation_result", "filterResults", "filter_results"))

    def chosen(camel: str, snake: str) -> str:
        return f"coalesce(nullif({camel}, ''), nullif({snake}, ''))"

    def odd(s: str) -> list[str]:
        """What the parser lets pass in the filters of a result: nulls among objects, and scores that are no numbers."""
        tests = []
        for f in (f"{s}.filterResults", f"{s}.filter_results"):
            for part in ("piAndJailbreakFilterResult", "pi_and_jailbreak_filter_result"):
                score = f"{f}.pi_and_jailbreak.{part}.score"
                tests.append(f"({score} IS NOT NULL AND try_cast({score} AS double) IS NULL)")
            for part in ("raiFilterResult", "rai_filter_result"):
                for types in ("raiFilterTypeResults", "rai_filter_type_results"):
                    tests.append(f"coalesce(exists(map_values({f}.rai.{part}.{types}), z -> z IS NULL), false)")
            for part in ("sdpFilterResult", "sdp_filter_result"):
                for inspect in ("inspectResult", "inspect_result"):
                    tests.append(f"coalesce(exists({f}.sdp.{part}.{inspect}.findings, z -> z IS NULL), false)")
        return tests

    # What is no object is not given to the parser, which raises an error inside for each text of another shape than it is told.
    objects = f"coalesce(startswith(ltrim(' \\t\\n\\r', {name(response)}), '{{'), false)"
    whole = f"{objects} AND coalesce(json_object_keys({wrapped}) = array('answer', 'end'), false)"
    doubts = " OR ".join([*odd("_answer.sanitizationResult"), *odd("_answer.sanitization_result")])
    return (
        df.selectExpr("*", once(f"if({whole}, {parsed}, NULL)", "_parsed"))
        .selectExpr(*[name(c) for c in df.columns], "_parsed.answer AS _answer", "_parsed.bad IS NULL AND _parsed.answer IS NOT NULL AS _shaped")
        .selectExpr(
            *[name(c) for c in df.columns],
            f"(_shaped AND NOT ({doubts})) AS _readable",
            f"if({filled('_answer.sanitizationResult')}, _answer.sanitizationResult, _answer.sanitization_result) AS _result",
        )
        .selectExpr(
            *[name(c) for c in df.columns],
            f"if(_readable, coalesce({chosen('_result.filterMatchState', '_result.filter_match_state')}, "
            "'NO_MATCH_FOUND'), NULL) AS filter_match_state",
            f"if(_readable, coalesce({chosen('_result.invocationResult', '_result.invocation_result')}, "
            "'SUCCESS'), NULL) AS invocation_result",
            "coalesce(_result.filterResults, _result.filter_results) AS filters",
        )
    )


def read_audit(spark: SparkSession, path: str, line_order: bool = False) -> DataFrame:
    """An audit trail of JSON lines; blank lines are dropped.

    A line that cannot be read stays, with ``readable`` false. With ``line_order`` the
    lines of one file are one chain in the order of the file.
    """
    lines = read_lines(spark, path).where("trim(line) <> ''")
    parsed = lines.select(
        "file", "line_no", F.expr(f"from_json(line, '{AUDIT_SCHEMA}')").alias("r"),
        F.expr("coalesce(schema_of_variant(try_parse_json(line)) LIKE 'OBJECT%', false)").alias("readable"),
    )
    kept = ["file", "line_no"] if line_order else []
    return parsed.select(*kept, "readable", "r.*")
