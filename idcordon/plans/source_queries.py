"""Registered queries of sources and sinks that are files, and of grouping sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idcordon.config import ScanOptions
from idcordon.functions.catalog import CHECKSUM_RULES, ENTITIES, load_catalog
from idcordon.operators import report
from idcordon.operators.detect import scan_spans
from idcordon.plans import oracle as o
from idcordon.plans import views as v
from idcordon.plans.registry import ORACLES, audit_records, kept_spans, register, span_rows, texts
from idcordon.sources import records, sinks
from idcordon.sources import trail as trails
from idcordon.sources.shared import shared_dir

_KIND = {"entity_type": "key", "category": "category", "severity": "severity"}
_OF_KIND = ", ".join(f"({[getattr(e, a) for e in ENTITIES]})[ord + 1] AS {c}" for c, a in _KIND.items())


@register("detections_cube", f"""{o.resolved(o.texts_sql())}, rows_of AS (SELECT {_OF_KIND}, grp, text_id FROM kept JOIN texts USING (text_id))
    SELECT entity_type, category, severity, grp, CAST(GROUPING(entity_type, category, severity, grp) AS BIGINT) AS grouping_id,
      count(*) AS n_spans, count(DISTINCT text_id) AS n_texts FROM rows_of GROUP BY CUBE (entity_type, category, severity, grp)""")
def detections_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.detections_cube(kept_spans(spark, sf_dir), ["grp"])


# --- bytes that are no UTF-8 ------------------------------------------------------

# Broken sequences, and how many replacement characters each becomes: a lone byte, a cut character of
# three and of four bytes, an overlong form, a surrogate, a byte that goes on without a start.
_BROKEN = (("FF", 1), ("E282", 1), ("F09F98", 1), ("C0AF", 2), ("EDA080", 3), ("80", 1))


def _bytes(n: str) -> str:
    return f"CASE {n} % 7 " + " ".join(f"WHEN {i} THEN unhex('{h}')" for i, (h, _) in enumerate(_BROKEN)) + " ELSE unhex('C3A9') END"


def _shown(n: str) -> str:
    return f"CASE {n} % 7 " + " ".join(f"WHEN {i} THEN repeat(chr(65533), {k})" for i, (_, k) in enumerate(_BROKEN)) + " ELSE 'é' END"


@register("src_events_bytes", f"""SELECT event_id, 'c' || {_shown('event_id')} || CAST(user_id AS STRING) AS conversation_id, CAST(event_id % 50 AS BIGINT) AS step_idx,
      'pay ' || {_shown('user_id')} || '-' || {_shown('event_id')} || ' ' || event_type AS prompt, true AS readable FROM events""")
def src_events_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come as bytes, parts of which are no UTF-8."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = "encode({0}, 'UTF-8')".format
    payload = ", ".join([
        text("'{\"conversationId\":\"c'"), _bytes("event_id"),
        text("concat(cast(user_id AS string), '\",\"stepIdx\":', cast(event_id % 50 AS string), ',\"prompt\":\"pay ')"),
        _bytes("user_id"), text("'-'"), _bytes("event_id"), text("concat(' ', event_type, '\"}')"),
    ])
    parsed = records.parse_events(events.selectExpr("event_id", f"concat({payload}) AS payload"))
    return parsed.select(
        "event_id", "conversation_id", "step_idx", F.expr("try_variant_get(event, '$.prompt', 'string')").alias("prompt"),
        F.col("event").isNotNull().alias("readable"),
    )


# --- files ------------------------------------------------------------------------

_FILES = 5


@register("src_transcript_files", f"""WITH given AS ({v.TRANSCRIPTS.sql()}),
    placed AS (SELECT CAST(conversation_id % {_FILES} AS BIGINT) AS file, line, row_number() OVER (PARTITION BY conversation_id % {_FILES} ORDER BY conversation_id, line_no) - 1 AS line_no FROM given)
    SELECT file, line_no, coalesce(json_extract_string(line, '$.type'), '') AS type, coalesce(json_extract_string(line, '$.source'), '') AS source,
      coalesce(json_extract_string(line, '$.content'), '') AS content FROM (SELECT file, line_no, CASE WHEN json_valid(line) THEN line END AS line FROM placed) WHERE line IS NOT NULL""")
def src_transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written to a few files and read back in many splits; every line keeps its place in its file."""
    path = shared_dir(spark, "transcripts")
    lines = v.TRANSCRIPTS.frame(spark, sf_dir).select((F.col("conversation_id") % _FILES).alias("file"), "conversation_id", "line_no", F.col("line").alias("value"))
    lines.repartition(_FILES, "file").sortWithinPartitions("file", "conversation_id", "line_no").select("file", "value").write.partitionBy("file").text(path)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "32k")
    try:  # the lines are read and stored in here
        read = records.read_lines(spark, path)
    finally:
        spark.conf.set(setting, before)
    number = F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("bigint")
    return records.parse_transcript_lines(read.withColumn("file", number)).select("file", "line_no", "type", "source", "content")


_SKIPPED = "PIN_CODE_IN"


@register("scan_loaded_catalog", o.spans_sql([e.key for e in ENTITIES if e.key != _SKIPPED]))
def scan_loaded_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with a catalog read from a file, of which one entry has no pattern and is skipped."""
    rules = {rule: known for known, rule in CHECKSUM_RULES.items()}
    entries = {
        e.key: {"name": e.name, "category": e.category, "severity": e.severity, "regulatory_frameworks": list(e.frameworks),
                "regex": None if e.key == _SKIPPED else e.pattern, "checksum_algorithm": rules.get(e.check)}
        for e in ENTITIES
    }
    path = shared_dir(spark, "catalog")
    spark.createDataFrame([(json.dumps({"entities": entries}),)], "value string").coalesce(1).write.text(path)
    loaded = load_catalog(spark, path)
    return span_rows(scan_spans(texts(spark, sf_dir), ["text_id"], options=ScanOptions(catalog=loaded)))


@register("route_written", ORACLES["sink_route_regulated"])
def route_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to their stores in one pass; the regulated store is read by its folder."""
    path = shared_dir(spark, "routed")
    sinks.write_routed(scan_spans(texts(spark, sf_dir), ["text_id"]), path)
    return sinks.read_routed(spark, path).select("text_id", "entity_type", "start_index")


@register("retention_removed", ORACLES["retention"])
def retention_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail after the days that are no longer kept were removed from its folders."""
    path = shared_dir(spark, "kept-trail")
    trails.append_once(audit_records(spark, sf_dir), path, "1", o.SALT)
    trails.drop_expired(spark, path, "2031-01-10")
    return trails.read_trail(spark, path).select("chain_id", "seq", "event_date")
