"""The registered queries and the SQL that checks them.

Every query reads whole given tables, or views derived from every row of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idcordon.config import PolicyOptions, ScanOptions
from idcordon.functions.canonical import event_hash
from idcordon.functions.catalog import ENTITIES, catalog_frame
from idcordon.functions.levels import confidence_at_least, severity_at_least
from idcordon.functions.masks import mask_by_type
from idcordon.functions.validators import NAMED_RULES
from idcordon.operators import audit as audit_ops
from idcordon.operators import controls, extract, quality, report
from idcordon.operators.detect import entity_name, explode_spans, scan_spans, with_hits
from idcordon.operators.gate import gate, overall_verdict
from idcordon.operators.policy import evaluate_policy, with_rules
from idcordon.operators.redact import apply_action_mode
from idcordon.operators.resolve import with_spans
from idcordon.operators.turns import turn_blocks
from idcordon.plans import oracle as o
from idcordon.plans import views as v
from idcordon.plans.guard import card_documents, guard_and_audit, guard_events, stream_guard_events
from idcordon.sources import records, sinks
from idcordon.sources.shared import shared_dir, stored
from idcordon.streaming.scan import stream_scan
from idcordon.streaming.tables import drain, parquet_stream
from idcordon.streaming.turns import stream_turn_blocks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[key] = lambda spark, sf_dir: query(records.prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [view.frame(spark, sf_dir) for view in v.TEXT_VIEWS]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


def reports(spark: SparkSession, sf_dir: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    return report.text_report(texts(spark, sf_dir), "text", options)


def kept_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spans(with_hits(texts(spark, sf_dir)))


def span_rows(df: DataFrame) -> DataFrame:
    return df.select("text_id", "entity_type", "severity", "start_index", "end_index", "masked_value")


def only(*keys: str) -> ScanOptions:
    return ScanOptions(allowed=tuple(e.key for e in ENTITIES if e.key not in keys))


# --- sources and sinks ------------------------------------------------------------

_CATALOG_ROWS = ", ".join(
    f"({i}, {o.q(e.key)}, {o.q(e.name)}, {o.q(e.category)}, {o.q(e.severity)}, {o.q(','.join(e.frameworks))})"
    for i, e in enumerate(ENTITIES)
)


@register("src_catalog", f"""{o.resolved(o.texts_sql())}
    SELECT CAST(c.i AS BIGINT) AS entity_ord, c.k AS entity_type, c.n AS entity_name, c.cat AS category, c.sev AS severity,
           c.f AS frameworks, count(kept.text_id) AS n_spans
    FROM (VALUES {_CATALOG_ROWS}) AS c(i, k, n, cat, sev, f) LEFT JOIN kept ON kept.ord = c.i GROUP BY ALL""")
def src_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, with what the texts hold of each kind."""
    found = report.detections_rollup(kept_spans(spark, sf_dir), ["key"])
    return catalog_frame(spark).join(F.broadcast(found), "entity_type", "left").select(
        "entity_ord", "entity_type", "entity_name", "category", "severity",
        F.array_join("frameworks", ",").alias("frameworks"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )


@register("src_events_json", f"""WITH {o.events()}
    SELECT event_id, coalesce(json_extract_string(j, '$.conversationId'), 'unknown') AS conversation_id,
           CAST(json_extract_string(j, '$.stepIdx') AS BIGINT) AS step_idx,
           json_extract_string(j, '$.transcriptPath') AS transcript_path,
           json_extract_string(j, '$.toolCall.name') AS tool_name, j IS NOT NULL AS readable FROM ev""")
def src_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = records.parse_events(v.PAYLOADS.frame(spark, sf_dir).select("event_id", "payload"))
    return parsed.select(
        "event_id", "conversation_id", "step_idx", "transcript_path", "tool_name",
        F.col("event").isNotNull().alias("readable"),
    )


@register("src_transcript_jsonl", f"WITH {o.prompts()} SELECT conversation_id, line_no, type, source, content FROM steps")
def src_transcript_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_transcript_lines(v.TRANSCRIPTS.frame(spark, sf_dir))


@register("src_filter_response", f"""WITH {o.policy(v.RESPONSES.sql())}
    SELECT k, state AS filter_match_state, invoked AS invocation_result FROM unwrapped""")
def src_filter_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = records.parse_responses(v.RESPONSES.frame(spark, sf_dir))
    return parsed.select("k", "filter_match_state", "invocation_result")


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = v.AUDIT.frame(spark, sf_dir)
    clock = audit_ops.utc_clock(view, "ts")
    return view.selectExpr(
        "chain_id", "seq", "event_id", "conversation_id", "cast(step_idx AS bigint) AS step_idx",
        "hook_name", "decision", "cast(risk AS double) AS risk_score",
        "array(violation) AS detected_violations", f"{audit_ops.iso_utc(clock)} AS timestamp_utc",
        f"{audit_ops.india_time(clock)} AS timestamp_ist", f"to_date({clock}) AS event_date", "kind",
    )


def stored_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained audit records as a stored table."""
    path = shared_dir(spark, "trail")
    chained = audit_ops.chain_events(audit_records(spark, sf_dir), o.SALT)
    sinks.append_audit(chained, path)
    return spark.read.parquet(path)


@register("src_audit_jsonl", f"""{o.chained()}
    SELECT event_id, conversation_id, decision, CAST(risk AS DOUBLE) AS risk_score, violation, l.event_hash AS event_hash, true AS readable
    FROM links l JOIN au USING (seq)""")
def src_audit_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the trail as JSON lines, read it back."""
    path = shared_dir(spark, "audit-lines")
    trail = audit_ops.chain_events(audit_records(spark, sf_dir), o.SALT)
    trail.select(F.to_json(F.struct(*trail.columns)).alias("value")).write.text(path)
    return records.read_audit(spark, path).select(
        "event_id", "conversation_id", "decision", "risk_score",
        F.get("detected_violations", F.lit(0)).alias("violation"), "event_hash", "readable",
    )


@register("src_controls", f"""{o.resolved(o.texts_sql())}, targets AS (
      SELECT framework, control_id, unnest(targets) AS target FROM {o.control_rows()}),
    found AS (SELECT {o._TYPE} AS target, count(*) AS n, count(DISTINCT text_id) AS t FROM kept GROUP BY 1)
    SELECT framework, control_id, target, coalesce(n, 0) AS n_spans, coalesce(t, 0) AS n_texts FROM targets LEFT JOIN found USING (target)""")
def src_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.detections_rollup(kept_spans(spark, sf_dir), ["key"])
    targets = controls.controls_frame(spark).select(
        "framework", "control_id", F.explode("target_entities").alias("target")
    )
    return targets.join(
        F.broadcast(found.withColumnRenamed("entity_type", "target")), "target", "left"
    ).select(
        "framework", "control_id", "target",
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )


@register("sink_audit_append", f"""WITH {o.audit()}
    SELECT CAST(ts AS DATE) AS event_date, count(*) AS n_events, count(DISTINCT chain_id) AS n_chains FROM au GROUP BY 1""")
def sink_audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_trail(spark, sf_dir).groupBy("event_date").agg(
        F.count("*").alias("n_events"), F.count_distinct("chain_id").alias("n_chains")
    )


@register("sink_route_regulated", f"""{o.detect(o.texts_sql())}
    SELECT text_id, {o._TYPE} AS entity_type, s AS start_index FROM cand
    WHERE ord IN ({', '.join(str(i) for i, e in enumerate(ENTITIES) if set(e.frameworks) & set(sinks.REGULATED_TAGS))})""")
def sink_route_regulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_spans(texts(spark, sf_dir), ["text_id"])
    return sinks.route_regulated(rows).select("text_id", "entity_type", "start_index")


# --- texts of events --------------------------------------------------------------

def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_events(v.PAYLOADS.frame(spark, sf_dir))


def transcript_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = records.parse_transcript_lines(v.TRANSCRIPTS.frame(spark, sf_dir)).withColumn(
        "transcript_path", F.concat(F.lit("/t/"), F.col("conversation_id").cast("string"))
    )
    return lines


@register("latest_user_prompt", f"WITH {o.prompts()} SELECT conversation_id, latest_prompt FROM latest")
def latest_user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.latest_user_prompt(records.parse_transcript_lines(v.TRANSCRIPTS.frame(spark, sf_dir)))


@register("extract_text", f"WITH {o.extracted()} SELECT event_id, scan_text, text_source FROM ex")
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = extract.latest_user_prompt(transcript_prompts(spark, sf_dir), "transcript_path")
    return extract.extract_text(parsed_events(spark, sf_dir), prompts).select(
        "event_id", "scan_text", "text_source"
    )


@register("event_type", f"WITH {o.events()} SELECT event_id, {o.EVENT_KIND} AS event_type FROM ev")
def event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsed_events(spark, sf_dir).drop("event_type")
    return extract.event_type(parsed).select("event_id", "event_type")


@register("conversation_key", f"""WITH {o.events()}, keys AS (SELECT event_id,
      regexp_replace(coalesce(json_extract_string(j, '$.conversationId'), 'unknown'), '[^A-Za-z0-9_-]', '', 'g') AS c FROM ev)
    SELECT event_id, CASE WHEN c IN ('', 'unknown') THEN 'default' ELSE c END AS conversation FROM keys""")
def conversation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_events(spark, sf_dir).selectExpr(
        "event_id", f"{extract.conversation_key('conversation_id')} AS conversation"
    )


@register("skip_empty", rf"""WITH {o.extracted()} SELECT event_id, regexp_full_match(scan_text, '\s*') AS skipped FROM ex""")
def skip_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(spark, sf_dir)
    return extract.skip_empty(found).select("event_id", "skipped")


@register("severity_at_least", f"""SELECT event_id,
      CASE sev WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END >=
      CASE least_ WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS at_least
    FROM (SELECT event_id, ['CRITICAL','HIGH','MEDIUM','LOW','NONE'][1 + event_id % 5] AS sev,
          ['CRITICAL','HIGH','MEDIUM','LOW'][1 + user_id % 4] AS least_ FROM events)""")
def severity_at_least_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sev = "get(array('CRITICAL','HIGH','MEDIUM','LOW','NONE'), cast(event_id % 5 AS int))"
    least = "get(array('CRITICAL','HIGH','MEDIUM','LOW'), cast(user_id % 4 AS int))"
    return events.selectExpr("event_id", f"{sev} AS sev", f"{least} AS least_").selectExpr(
        "event_id", f"{severity_at_least('sev', 'least_')} AS at_least"
    )


@register("confidence_at_least", f"""SELECT event_id,
      CASE c WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END >=
      CASE t WHEN 'HIGH' THEN 3 WHEN 'medium_and_above' THEN 2 WHEN 'LOW_AND_ABOVE' THEN 1 ELSE 1 END AS at_least
    FROM (SELECT event_id, ['HIGH','MEDIUM','LOW','CONFIDENCE_LEVEL_UNSPECIFIED','ODD'][1 + event_id % 5] AS c,
          ['HIGH','medium_and_above','LOW_AND_ABOVE','WHATEVER'][1 + user_id % 4] AS t FROM events)""")
def confidence_at_least_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    conf = "get(array('HIGH','MEDIUM','LOW','CONFIDENCE_LEVEL_UNSPECIFIED','ODD'), cast(event_id % 5 AS int))"
    bound = "get(array('HIGH','medium_and_above','LOW_AND_ABOVE','WHATEVER'), cast(user_id % 4 AS int))"
    return events.selectExpr("event_id", f"{conf} AS c", f"{bound} AS t").selectExpr(
        "event_id", f"{confidence_at_least('c', 't')} AS at_least"
    )


# --- detection --------------------------------------------------------------------

@register("scan_spans", o.spans_sql())
def scan_spans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(scan_spans(texts(spark, sf_dir), ["text_id"]))


def _detect(key: str) -> None:
    @register(f"detect_{key.lower()}", o.spans_sql([key]))
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return span_rows(scan_spans(texts(spark, sf_dir), ["text_id"], options=only(key)))


for _entity in ENTITIES:
    _detect(_entity.key)

_NOT_ALLOWED = [e.key for e in ENTITIES if e.key not in ("PHONE_IN", "PIN_CODE_IN", "UPI_VPA")]


@register("allowed_entities", o.spans_sql(_NOT_ALLOWED))
def allowed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ScanOptions(allowed=("PHONE_IN", "PIN_CODE_IN", "UPI_VPA"))
    return span_rows(scan_spans(texts(spark, sf_dir), ["text_id"], options=options))


@register("strict_off", o.spans_sql(strict=False))
def strict_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(scan_spans(texts(spark, sf_dir), ["text_id"], options=ScanOptions(strict=False)))


@register("card_documents", f"""{o.detect("SELECT doc_id AS text_id, source AS grp, text FROM documents", ["CREDIT_DEBIT_CARD"])},
    kept AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY s) - 1 AS n,
             coalesce(lag(e) OVER (PARTITION BY text_id ORDER BY s), 0) AS before FROM cand),
    sums AS (SELECT text_id, count(*) AS total, max(e) AS tail,
             string_agg(substr(texts.text, CAST(before + 1 AS BIGINT), s - before) || m, '' ORDER BY n) AS head
             FROM kept JOIN texts USING (text_id) GROUP BY text_id)
    SELECT text_id AS doc_id, total AS total_matches, 'CRITICAL' AS highest_severity, true AS blocked_by_policy,
           head || substr(text, tail + 1) AS redacted_text FROM sums JOIN texts USING (text_id)""")
def card_documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents with a valid payment card number, redacted."""
    return card_documents(v.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))


# --- validity ---------------------------------------------------------------------

_VALIDITY = {
    "validate_aadhaar": ("aadhaar", "aadhaar"),
    "validate_card": ("card", "card"),
    "validate_gstin": ("gstin", "gstin"),
    "validate_pan": ("pan", "pan"),
    "validate_ifsc": ("ifsc", "ifsc"),
    "validate_upi": ("upi", "upi"),
    "validate_phone": ("phone", "phone"),
    "validate_driving_licence": ("licence", "driving_licence"),
    "validate_passport": ("passport", "passport"),
    "validate_cin": ("cin", "cin"),
    "validate_pin_code": ("pin", "pin_code"),
    "validate_account": ("account", "account"),
}


def _validate(key: str, column: str, rule: str) -> None:
    @register(key, o.validity(v.IDS, column, rule))
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quality.validity_counts(v.IDS.frame(spark, sf_dir), column, rule, "grp")


for _key, (_column, _rule) in _VALIDITY.items():
    _validate(_key, _column, _rule)

_ANY = " ".join(
    f"WHEN {o.q(n)} THEN CASE WHEN value IS NULL THEN 'missing' WHEN {o.CHECKS[r]('value')} THEN 'valid' ELSE 'invalid' END"
    for n, r in NAMED_RULES.items()
)


@register("validate_any", f"SELECT k, entity, CASE upper(entity) {_ANY} ELSE 'unknown' END AS verdict FROM ({v.NAMED.sql()})")
def validate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_named(v.NAMED.frame(spark, sf_dir), "entity", "value").select("k", "entity", "verdict")


@register("append_check_digit", f"SELECT k, {o.CHECK_DIGIT} AS check_digit FROM ({v.BODIES.sql()})")
def append_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.append_check_digit(v.BODIES.frame(spark, sf_dir), "body").select("k", "check_digit")


# --- resolution, masks, reports ---------------------------------------------------

@register("resolve_overlaps", f"""{o.resolved(o.texts_sql())}
    SELECT text_id, n AS span_no, {o._TYPE} AS entity_type, s AS start_index, e AS end_index FROM kept""")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_spans(kept_spans(spark, sf_dir), ["text_id"], "spans").select(
        "text_id", "span_no", "entity_type", "start_index", "end_index"
    )


_TYPES = ["AADHAAR", "PAN", "CREDIT_DEBIT_CARD", "GSTIN", "IFSC", "UPI_VPA", "PHONE_IN",
          "DRIVING_LICENSE_IN", "PASSPORT_IN", "CIN_IN", "PIN_CODE_IN", "VOTER_ID_IN", "CARD_CVV",
          "BANK_ACCOUNT_IN", "MICR", "SOMETHING"]
_TYPE_OF = f"{v._pick('k', [o.q(t) for t in _TYPES])} AS entity_type"
_MASKED = " ".join(f"WHEN {o.q(t)} THEN {m('value')}" for t, m in o.MASKS.items())


@register("mask_value", f"""SELECT k, entity_type, CASE WHEN value IS NULL THEN NULL ELSE
      CASE entity_type {_MASKED} ELSE '[REDACTED_' || entity_type || ']' END END AS masked
    FROM (SELECT k, {_TYPE_OF}, value FROM ({v.NAMED.sql()}))""")
def mask_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = v.NAMED.frame(spark, sf_dir).selectExpr("k", _TYPE_OF, "value")
    return named.selectExpr(
        "k", "entity_type", f"if(value IS NULL, NULL, {mask_by_type('entity_type', 'value')}) AS masked"
    )


_REPORT = o.reports(o.texts_sql())


@register("redact_text", f"{_REPORT} SELECT text_id, redacted_text FROM report")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("text_id", "redacted_text")


@register("text_report", f"""{_REPORT} SELECT text_id, contains_pii, total_matches, highest_severity, blocked_by_policy,
      violation_summary, redacted_text, scanned_length FROM report""")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select(
        "text_id", "contains_pii", "total_matches", "highest_severity", "blocked_by_policy",
        "violation_summary", "redacted_text", "scanned_length",
    )


def _mode(mode: str, out: str, warning: str) -> None:
    acts = "blocked_by_policy" if mode == "BLOCK" else "contains_pii"

    @register(f"apply_action_mode_{mode.lower()}", f"""{_REPORT} SELECT text_id,
        CASE WHEN {acts} THEN '{mode}' ELSE 'ALLOW' END AS action_taken, {out} AS text_out, {warning} AS warning FROM report""")
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = ScanOptions(action_mode=mode)
        acted = apply_action_mode(reports(spark, sf_dir, options), "text", options)
        return acted.select("text_id", "action_taken", "text_out", "warning")


_NULL = "CAST(NULL AS VARCHAR)"
_mode("BLOCK", "CASE WHEN NOT blocked_by_policy THEN coalesce(text, '') END", _NULL)
_mode("MASK", "redacted_text", _NULL)
_mode("WARN", "coalesce(text, '')", "CASE WHEN contains_pii THEN violation_summary END")
_mode("AUDIT", "coalesce(text, '')", _NULL)


@register("entity_counts", f"{_REPORT} SELECT text_id, {o._NAME} AS entity_name, n_spans, "
          "row_number() OVER (PARTITION BY text_id ORDER BY first_seen) - 1 AS first_seen FROM kinds")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.entity_counts(kept_spans(spark, sf_dir), ["text_id"]).select(
        "text_id", "entity_name", "n_spans", "first_seen"
    )


@register("violation_summary", f"{_REPORT} SELECT text_id, violation_summary FROM report")
def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("text_id", "violation_summary")


@register("block_decision", f"{_REPORT} SELECT text_id, highest_severity, coalesce(highest_severity = 'CRITICAL', false) AS blocked FROM report")
def block_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block from CRITICAL upwards only."""
    found = reports(spark, sf_dir, ScanOptions(min_severity="CRITICAL"))
    return found.select("text_id", "highest_severity", F.col("blocked_by_policy").alias("blocked"))


@register("pii_risk_score", f"{_REPORT} SELECT text_id, pii_risk_score FROM report")
def pii_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("text_id", "pii_risk_score")


_SEV_OF_KIND = o.RANK_NAME("rnk")
_CAT_OF_KIND = f"({[e.category for e in ENTITIES]})[ord + 1]"


@register("detections_rollup", f"""{o.resolved(o.texts_sql())} SELECT {o._TYPE} AS entity_type, {_CAT_OF_KIND} AS category,
      {_SEV_OF_KIND} AS severity, grp, count(*) AS n_spans, count(DISTINCT text_id) AS n_texts
    FROM kept JOIN texts USING (text_id) GROUP BY ALL""")
def detections_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.detections_rollup(kept_spans(spark, sf_dir), ["key", "category", "severity"], ["grp"])


@register("detections_by_severity", f"""{o.resolved(o.texts_sql())} SELECT {_SEV_OF_KIND} AS severity,
      count(*) AS n_spans, count(DISTINCT text_id) AS n_texts FROM kept GROUP BY ALL""")
def detections_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.detections_rollup(kept_spans(spark, sf_dir), ["severity"])


@register("detections_by_category", f"""{o.resolved(o.texts_sql())} SELECT {_CAT_OF_KIND} AS category, grp,
      count(*) AS n_spans, count(DISTINCT text_id) AS n_texts FROM kept JOIN texts USING (text_id) GROUP BY ALL""")
def detections_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.detections_rollup(kept_spans(spark, sf_dir), ["category"], ["grp"])


@register("framework_rollup", f"""{o.resolved(o.texts_sql())} SELECT framework, count(*) AS n_spans FROM (
      SELECT unnest(({[list(e.frameworks) for e in ENTITIES]})[ord + 1]) AS framework FROM kept) GROUP BY framework""")
def framework_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.framework_rollup(kept_spans(spark, sf_dir))


# --- policy -----------------------------------------------------------------------

_JUDGED = f"WITH {o.policy(v.RESPONSES.sql())}"


def _policy_rule(key: str, rule: str) -> None:
    @register(key, f"{_JUDGED} SELECT k, len({rule}) > 0 AS found, array_to_string({rule}, '; ') AS violations FROM ruled")
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = with_rules(v.RESPONSES.frame(spark, sf_dir))
        return rules.select("k", (F.size(rule) > 0).alias("found"), F.array_join(rule, "; ").alias("violations"))


for _rule in o.RULE_NAMES:
    _policy_rule(f"policy_{_rule}", _rule)


@register("policy_decision", f"{_JUDGED} SELECT k, decision, decision = 'allow' AS is_allowed, risk AS risk_score FROM judged")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = evaluate_policy(v.RESPONSES.frame(spark, sf_dir))
    return judged.select("k", "decision", "is_allowed", "risk_score")


@register("policy_decision_ask", f"WITH {o.policy(v.RESPONSES.sql(), ai=1, action='force_ask')} SELECT k, decision, risk AS risk_score FROM judged")
def policy_decision_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask instead of denying, with a lower threshold for responsible AI."""
    options = PolicyOptions(action_on_match="FORCE_ASK", responsible_ai_threshold="LOW_AND_ABOVE")
    return evaluate_policy(v.RESPONSES.frame(spark, sf_dir), options).select("k", "decision", "risk_score")


@register("policy_reason_codes", f"""{_JUDGED} SELECT k, reason, array_to_string(rbi, ',') AS rbi_codes,
      array_to_string(sebi, ',') AS sebi_codes, array_to_string(viol, '; ') AS violations, risk AS risk_score FROM judged""")
def policy_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = evaluate_policy(v.RESPONSES.frame(spark, sf_dir))
    return judged.select(
        "k", "reason", F.array_join("rbi_codes", ",").alias("rbi_codes"),
        F.array_join("sebi_codes", ",").alias("sebi_codes"),
        F.array_join("violations", "; ").alias("violations"), "risk_score",
    )


# --- gates ------------------------------------------------------------------------

_SPIKED_REPORT = o.reports(f"SELECT k AS text_id, grp, text FROM ({v.SPIKED.sql()})")
_GATED = o.gated(_SPIKED_REPORT, v.RESPONSES.sql(), "r.text_id")


def spiked_gate(spark: SparkSession, sf_dir: str, stages: tuple[str, ...]) -> DataFrame:
    judged = gate(v.SPIKED.frame(spark, sf_dir), "k", "text", v.RESPONSES.frame(spark, sf_dir), stages)
    return judged.select("k", "verdict", "stage", "reason", "risk_score")


@register("two_stage_gate", f"{_GATED} SELECT text_id AS k, verdict, stage, gate_reason AS reason, gate_risk AS risk_score FROM verdicts")
def two_stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiked_gate(spark, sf_dir, ("identifiers", "policy"))


@register("missing_response_denied", f"{_GATED} SELECT text_id AS k, verdict, gate_risk AS risk_score FROM verdicts WHERE stage = 'policy' AND p_missing")
def missing_response_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are denied because no usable answer came."""
    texts_ = v.SPIKED.frame(spark, sf_dir)
    judged = gate(texts_, "k", "text", v.RESPONSES.frame(spark, sf_dir))
    return judged.where("stage = 'policy' AND answer_missing").select("k", "verdict", "risk_score")


@register("stage1_only_gate", f"""{_SPIKED_REPORT} SELECT text_id AS k, CASE WHEN blocked_by_policy THEN 'deny' ELSE 'allow' END AS verdict,
      CASE WHEN blocked_by_policy THEN 'identifiers' ELSE 'passed' END AS stage, pii_risk_score AS risk_score FROM report""")
def stage1_only_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiked_gate(spark, sf_dir, ("identifiers",)).drop("reason")


@register("stage2_only_gate", f"""WITH {o.policy(v.RESPONSES.sql())}, t AS (SELECT k FROM ({v.SPIKED.sql()}))
    SELECT t.k, CASE WHEN coalesce(decision, 'deny') = 'allow' THEN 'allow' ELSE 'deny' END AS verdict,
           CASE WHEN coalesce(decision, 'deny') = 'allow' THEN 'passed' ELSE 'policy' END AS stage,
           CASE WHEN decision = 'allow' THEN 0.0 ELSE coalesce(risk, 1.0) END::DOUBLE AS risk_score
    FROM t LEFT JOIN judged USING (k)""")
def stage2_only_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiked_gate(spark, sf_dir, ("policy",)).drop("reason")


@register("overall_verdict", f"""{_SPIKED_REPORT}, {o.policy(v.RESPONSES.sql())}
    SELECT text_id AS k, blocked_by_policy, total_matches, highest_severity, coalesce(decision, 'deny') = 'allow' AS policy_allowed,
           coalesce(decision, 'deny') AS policy_decision, coalesce(risk, 1.0)::DOUBLE AS policy_risk,
           NOT blocked_by_policy AND coalesce(decision, 'deny') = 'allow' AS is_allowed
    FROM report LEFT JOIN judged ON judged.k = text_id""")
def overall_verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overall_verdict(v.SPIKED.frame(spark, sf_dir), v.RESPONSES.frame(spark, sf_dir), "k")


EVENT_RESPONSES = v.View(
    "events",
    tuple(
        tuple(c.replace("c_custkey", "event_id") for c in layer) for layer in v.RESPONSES.layers
    ),
    v.RESPONSES.where,
)


@register("tool_gate", o.gated(
    o.reports(f"""SELECT CAST(event_id AS STRING) AS text_id, conversation_id AS grp, scan_text AS text FROM (
        WITH {o.extracted()}, {o.turns()} SELECT ex.event_id, flags.conversation_id, ex.scan_text FROM ex
        JOIN flags USING (event_id) WHERE flags.kind = 'tool')""") + f""", {o.turns()}""",
    EVENT_RESPONSES.sql(), "CAST(r.text_id AS BIGINT)", ask=True,
    turn="(SELECT f.blocked FROM flags f WHERE CAST(f.event_id AS STRING) = r.text_id)",
) + " SELECT CAST(text_id AS BIGINT) AS event_id, verdict, stage, gate_reason AS reason, gate_risk AS risk_score FROM verdicts")
def tool_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: a blocked turn first, then both stages."""
    flags = turn_blocks(v.TURNS.frame(spark, sf_dir)).where("kind = 'tool'").select("event_id", "blocked")
    calls = extract_text(spark, sf_dir).join(flags.hint("merge"), "event_id")  # neither side is fit for a broadcast
    answers = EVENT_RESPONSES.frame(spark, sf_dir).withColumnRenamed("k", "event_id")
    judged = gate(calls, "event_id", "scan_text", answers, ask=True, turn_blocked="blocked")
    return judged.select("event_id", "verdict", "stage", "reason", "risk_score")


# --- controls ---------------------------------------------------------------------

# Violations of a text: its identifiers with their masks, and its policy violations.
_VIOLATIONS = f"""{_REPORT}, {o.policy(v.RESPONSES.sql())},
    shown AS (SELECT text_id, list({o._NAME} || ' (' || m || ')' ORDER BY n) AS found FROM kept GROUP BY text_id)"""


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier violations of every text, with the policy violations of spiked texts."""
    named = kept_spans(spark, sf_dir).where("size(spans) > 0").selectExpr(
        "text_id", f"transform(spans, q -> concat({entity_name('q.ord')}, ' (', q.masked, ')')) AS found"
    )
    judged = evaluate_policy(v.RESPONSES.frame(spark, sf_dir)).selectExpr(
        "concat('c', cast(k AS string)) AS text_id", "violations"
    )
    return named.join(judged.hint("merge"), "text_id", "left").selectExpr(
        "text_id", "concat(found, coalesce(violations, array())) AS violations"
    )


_BOTH_VIOLATIONS = "found || coalesce(viol, CAST([] AS VARCHAR[]))"


def _map(key: str, mapper: Callable[[str], str]) -> None:
    @register(f"map_controls_{key}", f"""{_VIOLATIONS} SELECT text_id, {o.mapped(o.WORDS[key], _BOTH_VIOLATIONS)} AS controls
        FROM shown LEFT JOIN judged ON text_id = 'c' || k""")
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = violations(spark, sf_dir)
        return found.selectExpr("text_id", f"array_join({mapper('violations')}, ',') AS controls")


_map("rbi", controls.map_controls_rbi)
_map("sebi", controls.map_controls_sebi)


@register("control_lookup", f"""{_JUDGED}, codes AS (SELECT k, unnest(rbi || sebi) AS control_id FROM judged)
    SELECT k, control_id, title, reference, requirement FROM codes LEFT JOIN {o.control_rows()} USING (control_id)""")
def control_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the controls that answers bring in; one of them is in no catalog."""
    codes = evaluate_policy(v.RESPONSES.frame(spark, sf_dir)).selectExpr(
        "k", "explode(concat(rbi_codes, sebi_codes)) AS control_id"
    )
    return controls.control_lookup(codes).select("k", "control_id", "title", "reference", "requirement")


@register("control_matrix", f"""{_JUDGED}, codes AS (SELECT unnest(rbi || sebi) AS control_id FROM judged),
    n AS (SELECT control_id, count(*) AS n FROM codes GROUP BY 1)
    SELECT framework, control_id, title, reference, requirement, array_to_string(targets, ', ') AS targets, coalesce(n, 0) AS n_denials
    FROM {o.control_rows()} LEFT JOIN n USING (control_id)""")
def control_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All controls with their targets and how many answers brought each one in."""
    counts = (
        evaluate_policy(v.RESPONSES.frame(spark, sf_dir))
        .selectExpr("explode(concat(rbi_codes, sebi_codes)) AS control_id")
        .groupBy("control_id")
        .agg(F.count("*").alias("n_denials"))
    )
    return controls.controls_frame(spark).join(F.broadcast(counts), "control_id", "left").select(
        "framework", "control_id", "title", "reference", "requirement",
        F.array_join("target_entities", ", ").alias("targets"),
        F.coalesce("n_denials", F.lit(0)).alias("n_denials"),
    )


@register("control_coverage", f"""{o.resolved(o.texts_sql())}, targets AS (
      SELECT framework, control_id, title, unnest(targets) AS target FROM {o.control_rows()}),
    found AS (SELECT {o._TYPE} AS target, count(*) AS n FROM kept GROUP BY 1)
    SELECT framework, control_id, title, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_spans, count(*) AS n_targets
    FROM targets LEFT JOIN found USING (target) GROUP BY ALL""")
def control_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.control_coverage(kept_spans(spark, sf_dir))


# --- audit ------------------------------------------------------------------------

_EVENT_TIME = "TIMESTAMP '2024-03-01 20:15:00'"


@register("audit_events", f"""{_GATED}, shown AS (SELECT text_id, list({o._NAME} || ' (' || m || ')' ORDER BY n) AS found,
      string_agg(m, '|' ORDER BY n) AS masks FROM kept GROUP BY text_id),
    times AS (SELECT c_custkey AS k, {_EVENT_TIME} + c_custkey * INTERVAL '1' SECOND AS ts FROM customer)
    SELECT g.grp AS chain_id, g.text_id AS seq, 'FSI-' || upper(left(sha256(g.grp || '|' || g.text_id || '|guard'), 12)) AS event_id,
      strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp_utc,
      strftime(ts + INTERVAL '330' MINUTE, '%Y-%m-%d %H:%M:%S IST') AS timestamp_ist,
      CASE WHEN stage = 'policy' THEN coalesce(p_decision, 'deny') ELSE verdict END AS decision, gate_reason AS reason, gate_risk AS risk_score,
      array_to_string(CASE stage WHEN 'identifiers' THEN found ELSE coalesce(viol, ['Fail-Closed Security Gate: {o.NO_ANSWER}']) END, '; ') AS violations,
      CASE WHEN stage = 'identifiers' THEN masks ELSE '' END AS masks,
      array_to_string(CASE WHEN stage = 'policy' THEN coalesce(rbi || sebi, ['RBI-ITG-SEC-01', 'SEBI-CSCRF-AI-01']) ELSE {o.FRAMEWORKS} END, ',') AS frameworks,
      stage AS meta_stage
    FROM verdicts g JOIN times ON times.k = g.text_id LEFT JOIN shown USING (text_id) WHERE verdict <> 'allow'""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = v.SPIKED.frame(spark, sf_dir).selectExpr(
        "*", f"cast({_EVENT_TIME} + k * INTERVAL '1' SECOND AS timestamp_ntz) AS ts"
    )
    judged = gate(timed, "k", "text", v.RESPONSES.frame(spark, sf_dir), keep=["grp", "ts"])
    events = audit_ops.audit_events(judged, "grp", "k", "ts", "guard")
    return events.select(
        "chain_id", "seq", "event_id", "timestamp_utc", "timestamp_ist", "decision", "reason", "risk_score",
        F.array_join("detected_violations", "; ").alias("violations"),
        F.array_join(F.col("masked_entities.masked_value"), "|").alias("masks"),
        F.array_join("regulatory_frameworks", ",").alias("frameworks"),
        F.col("caller_metadata")["stage"].alias("meta_stage"),
    )


@register("event_hash", f"WITH {o.audit()} SELECT event_id, sha256(head || '{o.GENESIS}' || tail) AS event_hash FROM au")
def event_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = event_hash(o.SALT, f"'{o.GENESIS}'")
    return audit_records(spark, sf_dir).selectExpr("event_id", f"{hashed} AS event_hash")


@register("chain_events", f"{o.chained()} SELECT chain_id, seq, prev_event_hash, event_hash FROM links")
def chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_ops.chain_links(audit_records(spark, sf_dir), o.SALT).drop("event_id")


@register("resume_chain", f"{o.chained()} SELECT chain_id, seq, prev_event_hash, event_hash FROM links")
def resume_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second going on from the stored end of the first."""
    events = audit_records(spark, sf_dir)
    middle = events.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    early, late = events.where(F.col("seq") <= middle), events.where(F.col("seq") > middle)
    first = stored(audit_ops.chain_links(early, o.SALT), "resume")
    return audit_ops.chain_links(late, o.SALT, resume=audit_ops.last_hashes(first)).unionByName(first).drop("event_id")


# A trail with three kinds of harm: a changed link, changed content, a record taken out.
_HARM = ("seq % 97 = 5", "seq % 89 = 7", "seq % 83 = 11")


def harmed(trail: DataFrame) -> DataFrame:
    link, content, gone = _HARM
    return trail.where(f"NOT ({gone})").selectExpr(
        *[c for c in trail.columns if c not in ("prev_event_hash", "decision")],
        f"if({link}, 'changed', prev_event_hash) AS prev_event_hash",
        f"if({content}, 'allow', decision) AS decision",
    )


@register("verify_links", f"""{o.chained()}, bad AS (SELECT chain_id, seq, CASE WHEN {_HARM[0]} THEN 'changed' ELSE prev_event_hash END AS p,
      event_hash FROM links WHERE NOT ({_HARM[2]}))
    SELECT chain_id, seq, coalesce(p <> lag(event_hash) OVER (PARTITION BY chain_id ORDER BY seq), false) AS broken FROM bad""")
def verify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = harmed(stored_trail(spark, sf_dir))
    return audit_ops.verify_links(trail).select("chain_id", "seq", "broken")


@register("verify_hashes", f"""WITH {o.audit()} SELECT chain_id, seq, {_HARM[0]} OR {_HARM[1]} AS altered FROM au WHERE NOT ({_HARM[2]})""")
def verify_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = harmed(stored_trail(spark, sf_dir))
    return audit_ops.verify_hashes(trail, o.SALT).select("chain_id", "seq", "altered")


@register("audit_tail", f"""WITH {o.audit()} SELECT chain_id, seq, event_id, decision, CAST(risk AS DOUBLE) AS risk_score,
      strftime(ts + INTERVAL '330' MINUTE, '%Y-%m-%d %H:%M:%S IST') AS timestamp_ist FROM au ORDER BY seq DESC LIMIT 10""")
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_ops.audit_tail(audit_records(spark, sf_dir), ["seq"]).select(
        "chain_id", "seq", "event_id", "decision", "risk_score", "timestamp_ist"
    )


@register("retention", f"""WITH {o.audit()} SELECT chain_id, seq, CAST(ts AS DATE) AS event_date FROM au
    WHERE CAST(ts AS DATE) >= DATE '2031-01-10' - {o.DAYS}""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    trail = stored_trail(spark, sf_dir)
    return audit_ops.retained(trail, "DATE '2031-01-10'").select("chain_id", "seq", "event_date")


# --- turns and streams ------------------------------------------------------------

@register("turn_block_state", f"WITH {o.turns()} SELECT event_id, kind, blocked FROM flags")
def turn_block_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_blocks(v.TURNS.frame(spark, sf_dir)).select("event_id", "kind", "blocked")


@register("post_terminate", f"WITH {o.turns()} SELECT event_id, blocked AS terminate FROM flags WHERE kind = 'post'")
def post_terminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_blocks(v.TURNS.frame(spark, sf_dir)).where("kind = 'post'").select("event_id", "terminate")


def streamed(spark: SparkSession, frame: DataFrame, order: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming job gives for a derived view that arrives in three parts, one after the other.

    Each part is appended to a folder and drained before the next one comes, so the state goes
    over from run to run through the stream's checkpoint.
    """
    source, out, checkpoint = (shared_dir(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    cuts = frame.agg(F.percentile_approx(order, [0.33, 0.67])).first()[0] or []
    place = " + ".join(f"CAST({order} > {_literal(c)} AS INT)" for c in cuts) or "0"
    for part in range(len(cuts) + 1):
        frame.where(f"{place} = {part}").write.mode("append").parquet(source)
        drain(job(parquet_stream(spark, source, frame.schema)), out, checkpoint)
    return spark.read.parquet(out)


def _literal(value: object) -> str:
    return str(value) if isinstance(value, int) else f"'{value}'"


@register("stream_scan", o.reports("SELECT doc_id AS text_id, source AS grp, text FROM documents")
          + " SELECT text_id AS doc_id, total_matches, highest_severity, redacted_text FROM report")
def stream_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    stream = parquet_stream(spark, path, spark.read.parquet(path).schema)
    out = drain(stream_scan(stream, ["doc_id"]))
    return spark.read.parquet(out).select("doc_id", "total_matches", "highest_severity", "redacted_text")


@register("turn_block_stream", f"WITH {o.turns()} SELECT event_id, kind, blocked, kind = 'post' AND blocked AS terminate FROM flags")
def turn_block_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = v.TURNS.frame(spark, sf_dir)
    return streamed(spark, turns, "event_id", stream_turn_blocks).select("event_id", "kind", "blocked", "terminate")


# --- whole jobs -------------------------------------------------------------------

_EVENT_TEXTS = f"""SELECT CAST(event_id AS STRING) AS text_id, '' AS grp, scan_text AS text FROM (
    WITH {o.extracted()} SELECT event_id, scan_text FROM ex)"""


_GUARDED = o.gated(o.reports(_EVENT_TEXTS), EVENT_RESPONSES.sql(), "CAST(r.text_id AS BIGINT)", ask=True) + f""",
    {o.events()},
    kinds_of AS (SELECT CAST(event_id AS STRING) AS text_id, ts, {o.EVENT_KIND} AS event_type,
        CAST(json_extract_string(j, '$.stepIdx') AS BIGINT) AS step_idx,
        regexp_replace(coalesce(json_extract_string(j, '$.conversationId'), 'unknown'), '[^A-Za-z0-9_-]', '', 'g') AS c FROM ev),
    both_of AS (SELECT v.*, ts, event_type, step_idx, CASE WHEN c IN ('', 'unknown') THEN 'default' ELSE c END AS conversation
        FROM verdicts v JOIN kinds_of USING (text_id)),
    marked_of AS (SELECT *, last_value(CASE WHEN event_type <> 'pre_tool_use' THEN
            struct_pack(hot := event_type = 'pre_invocation' AND verdict <> 'allow', at := ts) END IGNORE NULLS)
        OVER (PARTITION BY conversation ORDER BY ts, CAST(text_id AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM both_of),
    held_of AS (SELECT *, coalesce(was.hot AND date_diff('microsecond', was.at, ts) < 300000000, false) AS hot FROM marked_of),
    final_of AS (SELECT CAST(text_id AS BIGINT) AS event_id, text_id, conversation, event_type, ts, step_idx, p_decision, viol,
        CASE event_type WHEN 'pre_tool_use' THEN CASE WHEN hot THEN 'deny' ELSE verdict END WHEN 'post_invocation' THEN 'allow' ELSE verdict END AS verdict,
        CASE WHEN event_type = 'pre_tool_use' AND hot THEN 'turn' WHEN event_type = 'post_invocation' THEN 'skipped' ELSE stage END AS stage,
        CASE WHEN event_type = 'pre_tool_use' AND hot THEN 'Turn is blocked by an earlier denial.'
             WHEN event_type = 'post_invocation' THEN 'No text to scan.' ELSE gate_reason END AS reason,
        CASE WHEN event_type = 'post_invocation' OR (event_type = 'pre_tool_use' AND hot) THEN 0.0 ELSE gate_risk END::DOUBLE AS risk_score,
        event_type = 'post_invocation' AND hot AS terminate FROM held_of)"""


@register("guard_events", f"{_GUARDED} SELECT event_id, conversation, event_type, verdict, stage, reason, risk_score, terminate FROM final_of")
def guard_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = v.PAYLOADS.frame(spark, sf_dir).select("event_id", "ts", "payload")
    answers = EVENT_RESPONSES.frame(spark, sf_dir).withColumnRenamed("k", "event_id")
    judged = guard_events(payloads, transcript_prompts(spark, sf_dir), answers)
    return judged.select("event_id", "conversation", "event_type", "verdict", "stage", "reason", "risk_score", "terminate")


@register("guard_events_stream", f"{_GUARDED} SELECT event_id, conversation, event_type, verdict, stage, reason, risk_score, terminate FROM final_of")
def guard_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts from events that arrive in three parts."""
    payloads = v.PAYLOADS.frame(spark, sf_dir).select("event_id", "ts", "payload")
    answers = EVENT_RESPONSES.frame(spark, sf_dir).withColumnRenamed("k", "event_id")
    prompts = stored(extract.latest_user_prompt(transcript_prompts(spark, sf_dir), "transcript_path"), "prompts")
    answers = stored(answers, "answers")  # each part reads them
    judged = streamed(spark, payloads, "event_id", lambda stream: stream_guard_events(
        stream, prompts, answers, columns=("conversation", "event_type")
    ))
    return judged.select("event_id", "conversation", "event_type", "verdict", "stage", "reason", "risk_score", "terminate")


@register("guard_and_audit", f"""{_GUARDED},
    shown AS (SELECT text_id, list({o._NAME} || ' (' || m || ')' ORDER BY n) AS found FROM kept GROUP BY text_id),
    logged AS (SELECT conversation AS chain_id, event_id AS seq, row_number() OVER (PARTITION BY conversation ORDER BY event_id) AS n,
        CASE WHEN stage = 'policy' THEN coalesce(p_decision, 'deny') ELSE verdict END AS decision, step_idx, risk_score,
        'FSI-' || upper(left(sha256(conversation || '|' || event_id || '|guard'), 12)) AS audit_id,
        array_to_string(CASE stage WHEN 'identifiers' THEN found ELSE coalesce(viol, ['Fail-Closed Security Gate: {o.NO_ANSWER}']) END, '", "') AS listed,
        {o.ISO} AS stamp
      FROM final_of LEFT JOIN shown USING (text_id) WHERE verdict <> 'allow' AND stage <> 'turn'),
    texts_of AS (SELECT *, '{{"conversation_id": "' || chain_id || '", "decision": "' || decision || '", "detected_violations": ["' || listed
        || '"], "event_id": "' || audit_id || '", "hook_name": "guard", "prev_event_hash": "' AS head,
        '", "risk_score": ' || CAST(risk_score AS STRING) || ', "salt": "{o.SALT}", "step_idx": ' || coalesce(CAST(step_idx AS STRING), 'null')
        || ', "timestamp_utc": "' || stamp || '"}}' AS tail FROM logged),
    links AS (
        SELECT chain_id, seq, n, '{o.GENESIS}' AS prev_event_hash, sha256(head || '{o.GENESIS}' || tail) AS event_hash FROM texts_of WHERE n = 1
        UNION ALL
        SELECT x.chain_id, x.seq, x.n, l.event_hash, sha256(x.head || l.event_hash || x.tail)
        FROM links l JOIN texts_of x ON x.chain_id = l.chain_id AND x.n = l.n + 1)
    SELECT chain_id, seq, audit_id AS event_id, decision, prev_event_hash, event_hash FROM links JOIN logged USING (chain_id, seq)""")
def guard_and_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = v.PAYLOADS.frame(spark, sf_dir).select("event_id", "ts", "payload")
    answers = EVENT_RESPONSES.frame(spark, sf_dir).withColumnRenamed("k", "event_id")
    chained = guard_and_audit(payloads, transcript_prompts(spark, sf_dir), answers, o.SALT)
    return chained.select("chain_id", "seq", "event_id", "decision", "prev_event_hash", "event_hash")
