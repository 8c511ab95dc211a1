"""Input views of the registered queries, derived from the given tables.

A view is a base table and layers of select expressions written in the part of SQL that
Spark and DuckDB share, so that both engines see the same rows. They work on every row
of their base table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


PARTITIONS = "idcordon.input.partitions"

# Tables whose texts, payloads and answers are made from a few narrow columns.
_NARROW = ("customer", "orders", "events")


def dealt(df: DataFrame, narrow: bool = False) -> DataFrame:
    """The rows dealt to so many partitions as the session asks for, else as the source has them.

    For bench and trial runs over files of a single split; tables of many splits need no such setting. ``narrow`` rows,
    from which far more is made than is read, are always dealt, by default to the session's shuffle partitions: a split holds
    too many of them for one task.
    """
    conf = df.sparkSession.conf
    n = conf.get(PARTITIONS, "") or (conf.get("spark.sql.shuffle.partitions") if narrow else "")
    return df.repartition(int(n)) if n else df


@dataclass(frozen=True)
class View:
    table: str
    layers: tuple[tuple[str, ...], ...]
    where: str | None = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = dealt(spark.read.parquet(f"{sf_dir}/{self.table}.parquet"), self.table in _NARROW)
        for layer in self.layers:
            df = df.selectExpr(*layer)
        return df.where(self.where) if self.where else df

    def sql(self) -> str:
        text = self.table
        for layer in self.layers:
            text = f"(SELECT {', '.join(layer)} FROM {text})"
        return f"SELECT * FROM {text}" + (f" WHERE {self.where}" if self.where else "")


def _letter(n: str) -> str:
    return f"chr(CAST(65 + ({n}) % 26 AS INT))"


def _pick(n: str, values: list[str], otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE ({n}) % {len(values)} {cases} ELSE {otherwise} END"


_NUMBERS = (
    "k", "grp", "m",
    "CAST(200000000000 + (m * 829348951) % 799999999999 AS STRING) AS n12",
    "lpad(CAST((m * 729348953) % 1000000000000000 AS STRING), 15, '0') AS n15",
    f"{_letter('m')} || {_letter('m * 7 + 3')} || {_letter('m * 11 + 5')} AS l3",
    f"{_letter('m * 5 + 1')} AS l1",
    "substr('PCHFATBLJGXZ', CAST(m % 12 AS INT) + 1, 1) AS st",
    "lpad(CAST(m * 37 % 10000 AS STRING), 4, '0') AS d4",
)

_IDS = (
    "k", "grp", "m", "n15",
    "CASE m % 3 WHEN 0 THEN n12 WHEN 1 THEN substr(n12, 1, 4) || ' ' || substr(n12, 5, 4) || ' ' || "
    "substr(n12, 9, 4) ELSE substr(n12, 1, 4) || '-' || substr(n12, 5, 4) || '-' || substr(n12, 9, 4) END AS aadhaar",
    "l3 || st || l1 || d4 || CASE WHEN m % 5 = 0 THEN '7' ELSE l1 END AS pan",
    "lpad(CAST(m % 40 + 1 AS STRING), 2, '0') || l3 || st || l1 || d4 || l1 || '1Z' || "
    "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(m * 5 % 36 AS INT) + 1, 1) AS gstin",
    _pick("m", ["'account number: '", "'A/c '", "'acc no '", "'savings a/c #'", "'ACCOUNT-'"])
    + " AS account_words",
    "substr(n15 || n12, 1, CAST(8 + m % 12 AS INT)) AS account",
    "l3 || l1 || CASE WHEN m % 5 = 0 THEN '1' ELSE '0' END || substr(n15, 4, 6) AS ifsc",
    "substr(n15, 2, 9) AS micr",
    _pick("m", ["'user'", "'a'", "'pay.me_'", "'x-'"]) + " || CASE WHEN m % 4 = 1 THEN '' ELSE d4 END || '@' || "
    + _pick("m", ["'okaxis'", "'ybl'", "'somebank'", "'upi'", "'b2b'"]) + " AS upi",
    _pick("m", ["'4'", "'51'", "'6011'", "'6521'", "'607'", "'5081'"])
    + " || substr(n15 || n12, 1, CAST("
    + _pick("m", ["15", "14", "12", "12", "13", "12"]) + " AS INT)) AS card",
    "substr(n15, 5, CAST(2 + m % 4 AS INT)) AS cvv",
    _pick("m", ["'+91-9'", "'08'", "'7'", "'+91 6'", "'5'"])
    + " || CASE WHEN m % 10 = 2 THEN '777777777' ELSE substr(n15, 6, 9) END AS phone",
    "CAST(m % 10 AS STRING) || substr(n15, 9, 2) || CASE WHEN m % 3 = 0 THEN ' ' ELSE '' END || substr(n15, 11, 3) AS pin",
    "CASE WHEN m % 5 = 0 THEN 'A' ELSE 'U' END || substr(n15, 1, 5) || 'MH' || CASE WHEN m % 7 = 0 THEN '18' "
    "ELSE '19' END || substr(n15, 6, 2) || 'PLC' || substr(n15, 8, 6) AS cin",
    "CASE WHEN m % 4 = 0 THEN lower(l1) ELSE l1 END || CAST(m % 9 + 1 AS STRING) || substr(n15, 1, 1) || "
    "CASE WHEN m % 3 = 0 THEN ' ' ELSE '' END || substr(n15, 2, 4) || CAST(m % 10 AS STRING) AS passport",
    "l3 || substr(n15, 3, 7) AS voter",
    _pick("m", ["'MH'", "'DL'", "'XX'", "'KA'", "'TN'"])
    + " || CASE WHEN m % 2 = 0 THEN '-' ELSE '' END || substr(n15, 1, 2) || CASE WHEN m % 2 = 0 THEN '-' ELSE '' END || "
    "CASE WHEN m % 3 = 0 THEN '20' ELSE '19' END || substr(n15, 3, 2) || CASE WHEN m % 2 = 0 THEN '-' ELSE '' END || "
    "substr(n15, 5, CAST(6 + m % 3 AS INT)) AS licence",
)

_PARTS = [
    "'id ' || aadhaar", "'PAN ' || pan", "'passport ' || passport", "voter", "'DL ' || licence",
    "'GST ' || gstin", "account_words || account", "ifsc", 
    "CASE WHEN m % 2 = 0 THEN 'MICR code: ' || micr ELSE micr || ' cheque' END",
    "upi", "'card ' || card", "'CVV: ' || cvv", "'call ' || phone", "'PIN code ' || pin", "'CIN ' || cin",
]

_TEXT = (
    "CASE WHEN k % 11 = 0 THEN 'Nothing of interest in this note.' ELSE concat_ws(' ', "
    "CASE WHEN k % 5 = 0 THEN 'Réf ₹ 😀' ELSE 'Case' END, "
    f"{_pick('k', _PARTS)}, 'then', {_pick('k * 7 + 3', _PARTS)}, "
    "CASE WHEN k % 7 = 0 THEN 'account ' || n15 || ' pin 4' || substr(n15, 1, 5) || ' ' || card || '@okaxis ' || gstin END, "
    "'end.') END AS text"
)


def _keys(key: str, group: str) -> tuple[str, ...]:
    return (f"{key} AS k", f"CAST({group} AS STRING) AS grp", f"{key} % 1000000 AS m")


_ID_NAMES = (
    "aadhaar", "pan", "gstin", "account", "ifsc", "upi", "card", "phone", "pin", "cin",
    "passport", "licence",
)

# Texts with identifiers, one per customer.
SPIKED = View(
    "customer", (_keys("c_custkey", "c_nationkey"), _NUMBERS, _IDS, ("k", "grp", _TEXT))
)

# Identifier columns, one row per order; every thirteenth value is missing.
IDS = View(
    "orders",
    (
        _keys("o_orderkey", "o_orderpriority"),
        _NUMBERS,
        _IDS,
        ("k", "grp", "m", "n15",
         *[f"CASE WHEN (k + {i}) % 13 = 0 THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(_ID_NAMES)]),
    ),
)

# One value per order under an entity name, some unknown.
_NAMED = ["'AADHAAR'", "'pan'", "'CARD'", "'GSTIN'", "'IFSC'", "'UPI'", "'PHONE'", "'DL'",
          "'PASSPORT'", "'CIN'", "'PIN'", "'OTHER'"]
_NAMED_VALUES = ["aadhaar", "pan", "card", "gstin", "ifsc", "upi", "phone", "licence",
                 "passport", "cin", "pin", "voter"]
NAMED = View(
    "orders",
    (
        _keys("o_orderkey", "o_orderpriority"),
        _NUMBERS,
        _IDS,
        ("k", f"{_pick('m', _NAMED)} AS entity",
         f"CASE WHEN k % 13 = 0 THEN NULL ELSE {_pick('m', _NAMED_VALUES)} END AS value"),
    ),
)

BODIES = View(
    "orders",
    (("o_orderkey AS k", "CASE WHEN o_orderkey % 9 = 0 THEN '12 3' ELSE CAST(20000000000 + "
      "(o_orderkey % 1000000 * 829348951) % 79999999999 AS STRING) END AS body"),),
)

# Every text column of the given tables and the spiked texts, under one kind of key.
TEXT_VIEWS = (
    View("documents", (("concat('d', CAST(doc_id AS STRING)) AS text_id", "source AS grp", "text"),)),
    View("pages", (("concat('p', CAST(page_id AS STRING)) AS text_id", "'pages' AS grp", "html AS text"),)),
    View("conversations", (("concat('v', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS text_id",
                            "role AS grp", "text"),)),
    View("customer", (*SPIKED.layers, ("concat('c', CAST(k AS STRING)) AS text_id", "grp", "text"))),
)

_CLEAN = '{"sanitizationResult":{"filterMatchState":"NO_MATCH_FOUND","invocationResult":"SUCCESS","filterResults":{}}}'


def _answer(state: str, filters: str, snake: bool = False) -> str:
    if snake:
        return (
            f'{{"sanitization_result":{{"filter_match_state":"{state}",'
            f'"invocation_result":"SUCCESS","filter_results":{{{filters}}}}}}}'
        )
    return (
        f'{{"sanitizationResult":{{"filterMatchState":"{state}",'
        f'"invocationResult":"PARTIAL","filterResults":{{{filters}}}}}}}'
    )


_HIT, _MISS = "MATCH_FOUND", "NO_MATCH_FOUND"
_RAI = (
    '"rai":{"raiFilterResult":{"matchState":"MATCH_FOUND","raiFilterTypeResults":{'
    '"sexually_explicit":{"matchState":"MATCH_FOUND","confidenceLevel":"HIGH"},'
    '"harassment":{"confidenceLevel":"MEDIUM"},'
    '"dangerous":{"matchState":"MATCH_FOUND","confidenceLevel":"LOW"},'
    '"hate_speech":{"matchState":"NO_MATCH_FOUND","confidenceLevel":"HIGH"}}}}'
)
_URI = (
    '"malicious_uris":{"malicious_uri_filter_result":{"match_state":"MATCH_FOUND",'
    '"matched_uris":["http://a.example","http://b.example"]}}'
)
_CASES = [
    _CLEAN,
    _answer(_HIT, '"pi_and_jailbreak":{"pi_and_jailbreak_filter_result":{"match_state":"MATCH_FOUND",'
            '"confidence_level":"HIGH","score":0.97}}', snake=True),
    _answer(_HIT, '"pi_and_jailbreak":{"piAndJailbreakFilterResult":{"matchState":"MATCH_FOUND",'
            '"confidenceLevel":"STRANGE"}}'),
    _answer(_HIT, _RAI),
    _answer(_HIT, '"sdp":{"sdp_filter_result":{"inspect_result":{"match_state":"MATCH_FOUND","findings":['
            '{"info_type":"INDIA_PAN"},{"info_type":"CREDIT_CARD_NUMBER"},{"info_type":"INDIA_PAN"}]}}}', snake=True),
    _answer(_HIT, _URI, snake=True),
    _answer(_HIT, '"csam":{"csamFilterFilterResult":{"matchState":"MATCH_FOUND"}}'),
    _answer(_HIT, ""),
    _answer(_MISS, '"rai":{"rai_filter_result":{"match_state":"MATCH_FOUND","rai_filter_type_results":{'
            '"dangerous":{"match_state":"MATCH_FOUND","confidence_level":"LOW"}}}}', snake=True),
    "{not json",
    '{"sanitizationResult":{"filterMatchState":"NO_MATCH_FOUND","invocationResult":"FAILURE"}}',
    _answer(_HIT, '"pi_and_jailbreak":{"piAndJailbreakFilterResult":{"matchState":"MATCH_FOUND",'
            '"confidenceLevel":"CONFIDENCE_LEVEL_UNSPECIFIED","score":1}},'
            '"sdp":{"sdpFilterResult":{"inspectResult":{"matchState":"MATCH_FOUND"}}},'
            '"malicious_uris":{"maliciousUriFilterResult":{"matchState":"MATCH_FOUND","matchedUris":[]}}'),
    # Valid JSON that is no answer of the filter: none of these may let a text pass.
    "[]", '[{"a":1}]', '"x"', "null", "5", '{"sanitizationResult":"oops"}', '{"sanitization_result":[1]}',
    '{"sanitizationResult":{"filterResults":"bad"}}',
    _answer(_MISS, '"rai":{"raiFilterResult":{"matchState":"NO_MATCH_FOUND","raiFilterTypeResults":{"dangerous":"HIGH"}}}'),
    _answer(_MISS, '"rai":{"rai_filter_result":7}', snake=True),
    _answer(_MISS, '"sdp":{"sdpFilterResult":{"inspectResult":{"findings":["PAN"]}}}'),
    _answer(_MISS, '"malicious_uris":{"malicious_uri_filter_result":{"matched_uris":"http://a.example"}}', snake=True),
    _answer(_HIT, '"pi_and_jailbreak":{"piAndJailbreakFilterResult":{"matchState":"MATCH_FOUND","score":"abc"}}'),
    # And some that are, with little in them.
    "{}", '{"sanitizationResult":null}', '{"sanitizationResult":{}}', '{"sanitizationResult":{"filterResults":null}}',
    _answer(_HIT, '"pi_and_jailbreak":{"piAndJailbreakFilterResult":{"matchState":"MATCH_FOUND","score":"0.5"}}'),
]

# Answers of the safety filter for the spiked texts; every thirteenth has none.
RESPONSES = View(
    "customer",
    (
        (
            "c_custkey AS k",
            "c_custkey % 17 <> 0 AS success",
            "CASE WHEN c_custkey % 17 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'timeout' END END AS error_message",
            _pick("c_custkey", [f"'{c}'" for c in _CASES]) + " AS response",
        ),
    ),
    where="k % 13 <> 0",
)

_CONV = "'u-' || CAST(user_id % 8 AS STRING)"

# Events in JSON, one per row of the event table, some unreadable.
PAYLOADS = View(
    "events",
    (
        (
            "event_id", "ts", "user_id", "event_type",
            "CASE WHEN event_id % 23 = 0 THEN '{\"conversationId\": \"x' "
            "WHEN event_type = 'click' THEN '{\"conversationId\":\"' || " + _CONV +
            " || '\",\"stepIdx\":' || CAST(event_id % 50 AS STRING) || ',\"toolCall\":{\"name\":\"run\",\"args\":"
            "{\"Query\":\"find ' || CAST(event_id AS STRING) || '\",\"CommandLine\":\"ls PAN ABCPE1234F\",\"Message\":\"\",\"Content\":5' || "
            "CASE WHEN event_id % 7 = 3 THEN ',\"x\":1,\"x\":2' ELSE '' END || '}}}' "
            "WHEN event_type = 'view' THEN '{\"toolCall\":{\"name\":\"open\",\"args\":"
            "{\"z\":\"doc ' || CAST(user_id AS STRING) || '\",\"count\":' || CAST(event_id AS STRING) || "
            "CASE WHEN event_id % 11 = 4 THEN '5678901234567890' ELSE '' END || "
            "',\"flag\":true,\"ratio\":1.5,\"deep\":{\"a\":1},\"none\":null}},\"conversationId\":\"' || " + _CONV + " || '!\"}' "
            "WHEN event_type = 'signup' THEN '{\"conversationId\":\"unknown\",\"invocationNum\":' || CAST(event_id % 7 AS STRING) || "
            "CASE WHEN event_id % 2 = 0 THEN ',\"stepIdx\":null' ELSE '' END || '}' "
            "WHEN event_type = 'purchase' THEN '{\"conversationId\":\"' || " + _CONV +
            " || '\",\"transcriptPath\":\"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '/t/' || CAST(user_id AS STRING) END || "
            "'\",\"userPrompt\":\"buy\"}' "
            "ELSE '{\"stepIdx\":' || CAST(event_id % 9 AS STRING) || ',\"content\":' || CASE event_id % 3 WHEN 0 THEN '42' "
            "WHEN 1 THEN '\"card 4532015112830366 of ' || CAST(user_id AS STRING) || '\"' ELSE '\"  \"' END || '}' END AS payload",
        ),
    ),
)

# Transcript lines, one per conversation turn, some broken or empty.
_PLAIN = "replace(replace(replace(replace(text, chr(92), ' '), '\"', ' '), chr(10), ' '), chr(9), ' ')"
TRANSCRIPTS = View(
    "conversations",
    (
        (
            "conv_id AS conversation_id", "turn AS line_no",
            "CASE WHEN (conv_id + turn) % 9 = 8 THEN '{\"type\": broken' "
            "WHEN (conv_id + turn) % 9 = 7 THEN '' ELSE '{\"type\":\"' || CASE role WHEN 'user' THEN "
            "CASE WHEN turn % 4 = 2 THEN 'NOTE' ELSE 'USER_INPUT' END ELSE 'MODEL' END || '\",\"source\":\"' || "
            "CASE WHEN turn % 4 = 2 THEN 'USER_EXPLICIT' ELSE 'SYSTEM' END || '\"' || "
            "CASE WHEN (conv_id + turn) % 6 = 5 THEN '' ELSE ',\"content\":\"' || " + _PLAIN + " || '\"' END || '}' END AS line",
        ),
    ),
)

# Turn events: prompts, tools and after-events of eight busy conversations.
TURNS = View(
    "events",
    (
        (
            "'u-' || CAST(user_id % 8 AS STRING) AS conversation_id", "ts", "event_id",
            "CASE WHEN event_type IN ('click', 'view') THEN 'tool' WHEN event_type = 'signup' THEN 'post' "
            "ELSE 'prompt' END AS kind",
            "event_type = 'error' AS denied",
        ),
    ),
)

# Audit records without hashes, one per event, chained by user.
AUDIT = View(
    "events",
    (
        (
            "CASE WHEN user_id % 50 <> 7 THEN 'u' || CAST(user_id AS STRING) END AS chain_id", "event_id AS seq", "ts",
            "'FSI-' || lpad(CAST(event_id AS STRING), 12, '0') AS event_id",
            "'u' || CAST(user_id AS STRING) AS conversation_id",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 50 END AS step_idx",
            "'guard' AS hook_name",
            "CASE WHEN event_type = 'view' THEN 'force_ask' ELSE 'deny' END AS decision",
            "CASE WHEN event_type = 'click' THEN 0.7 WHEN event_type = 'view' THEN 0.0 WHEN event_type = 'error' "
            "THEN 1.0 ELSE 0.95 END AS risk",
            "CASE WHEN event_type = 'click' THEN 'Card (4532-XXXX-XXXX-0366)' WHEN event_type = 'error' "
            "THEN 'Réf \"₹\" 😀 ' || chr(9) || CAST(event_id AS STRING) ELSE 'Name (AB***@upi)' END AS violation",
            "event_type AS kind",
        ),
    ),
)
