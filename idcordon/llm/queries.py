"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idcordon.llm import chat as _chat
from idcordon.llm import ctw as _ctw
from idcordon.llm import decontam as _decontam
from idcordon.llm import html as _html
from idcordon.llm import licenses as _licenses
from idcordon.llm import lloyd as _lloyd
from idcordon.llm import mix as _mix
from idcordon.llm import quality as _quality
from idcordon.llm import ranked as _ranked
from idcordon.llm import rindex as _rindex
from idcordon.llm import setjoin as _setjoin
from idcordon.llm import syncmers as _syncmers
from idcordon.llm import toxicity as _toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_is(parts: int, value: int) -> Column:
    """Whether crc32 of the id's digits leaves that remainder; a null id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == value, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix.taken(_mix.mix(_table(spark, sf_dir, "documents"))).drop("source")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _setjoin.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract(_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = _crc_is(4, 2)
    scored = _toxicity.score(docs, _toxicity.train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ctw.score(_table(spark, sf_dir, "documents"), _crc_is(5, 1))


def op8_syncmer_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _syncmers.fingerprints(_table(spark, sf_dir, "documents"))


def op9_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rindex.removal_digests(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return _chat.digests(_chat.format_conversations(turns))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses.scan(_table(spark, sf_dir, "documents"))


def op13_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lloyd.report(*_lloyd.cluster(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_source_mix": op2_source_mix,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_html_extract": op4_html_extract,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_ctw_score": op7_ctw_score,
    "op8_syncmer_fingerprint": op8_syncmer_fingerprint,
    "op9_rindex_dedup": op9_rindex_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_ranked_search": op11_ranked_search,
    "op12_license_scan": op12_license_scan,
    "op13_lloyd_clusters": op13_lloyd_clusters,
}


def _escaped(column: str) -> str:
    """Characters of a guarded text in DuckDB: a backslash more for each backslash and each control string."""
    marks = ["chr(92)", *(f"'{c}'" for c in _chat.CONTROLS)]
    return f"length({column}) + " + " + ".join(f"(length({column}) - length(replace({column}, {m}, ''))) // length({m})" for m in marks)


_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _ranking() -> str:
    """Every document scored for every item, term by term."""

    def terms(key: str, table: str) -> str:
        found = f"regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
        return f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({found}) AS term FROM {table}) GROUP BY ALL"

    return f"""WITH tf AS ({terms("doc_id", "documents")}), asked AS ({terms("item_id", "benchmark")}),
      sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
      whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
      weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, whole GROUP BY term, nn),
      lengths AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM sizes, whole),
      scores AS (SELECT item_id, doc_id, CAST(sum(asked.tf * w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m))) AS BIGINT) AS score
        FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
      ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 20"""


def _licensed() -> str:
    """Every window of every text held against every template."""
    options = _licenses.LicenseOptions()
    rows = []
    for i, (label, text) in enumerate(options.templates):
        words, larger = _licenses.template_words(text), _licenses.larger_templates(options)[i]
        rows.append(f"({i}, '{label}', {_licenses.stride(text, options)}, {words}, {_licenses.needed(len(words), options.percent)}, CAST({larger} AS INT[]))")
    cases = {label: phrase.split() for label, phrase in _licenses.PHRASES.items()}
    found = " UNION ALL ".join(
        f"SELECT id, '{label}' AS label, spot FROM (SELECT id, words, unnest(range(len(words))) AS spot FROM worded) WHERE "
        + " AND ".join(f"words[spot + {j + 1}] = '{w}'" for j, w in enumerate(words))
        for label, words in cases.items()
    )
    return f"""WITH worded AS (SELECT row_number() OVER () AS id, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
      base AS ({found}),
      based AS (SELECT id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS base_labels FROM base GROUP BY id),
      templates AS (SELECT * FROM (VALUES {", ".join(rows)}) AS t(i, label, stride, t_words, m, larger)),
      strides AS (SELECT DISTINCT stride FROM templates),
      cut AS (SELECT id, stride, words, unnest(range(0, len(words), stride)) AS spot FROM worded, strides),
      windows AS (SELECT id, stride, spot, words[spot + 1 : spot + 2 * stride] AS part FROM cut),
      held AS (SELECT id, w.stride, spot, i, label, larger, len(list_intersect(part, t_words)) / len(t_words) AS share
        FROM windows w JOIN templates t ON t.stride = w.stride AND len(list_intersect(part, t_words)) >= m),
      blocks AS (SELECT id, stride, spot, list(i) AS held FROM held GROUP BY ALL),
      kept AS (SELECT id, label, share FROM held JOIN blocks USING (id, stride, spot) WHERE NOT list_has_any(larger, blocks.held)),
      others AS (SELECT id, list(DISTINCT label) AS labels, max(share) AS share FROM kept GROUP BY id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ','), '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
    FROM worded LEFT JOIN based USING (id) LEFT JOIN others USING (id)"""


def _clusters(k: int = 16, dims: int = 64, rounds: int = 3) -> str:
    """Lloyd's rounds over single components."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) AS row, vec_id, embedding FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        """parts AS (SELECT row, vec_id, d, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x
        FROM (SELECT row, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM kept))""",
        f"c0 AS (SELECT row - 1 AS c, d, x AS y FROM parts WHERE row <= {k})",
    ]
    for r in range(rounds + 1):
        steps += [
            f"far{r} AS (SELECT row, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS far FROM parts JOIN c{r} USING (d) GROUP BY ALL)",
            f"near{r} AS (SELECT row, c, far FROM far{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY far, c) = 1)",
        ]
        if r < rounds:
            mean = "CAST((total - ((total % n) + n) % n) // n AS BIGINT)"
            steps += [
                f"mean{r} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM parts JOIN near{r} USING (row) GROUP BY ALL)",
                f"c{r + 1} AS (SELECT c, d, CASE WHEN n IS NULL THEN y ELSE {mean} END AS y FROM c{r} LEFT JOIN mean{r} USING (c, d))",
            ]
    return f"""WITH {", ".join(steps)},
      shown AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INT) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
      CAST(sum(far) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM near{rounds} JOIN kept USING (row) JOIN shown USING (c)"""


def _linked(size: int = 5, percent: int = 75) -> str:
    """Every pair of texts that share a shingle, and what can be reached by links."""
    whole = "array_to_string(words, ' ')"
    each = f"list_transform(range(1, len(words) - {size - 2}), lambda i: array_to_string(words[i : i + {size - 1}], ' '))"
    return f"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
      shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [{whole}] ELSE {each} END) AS s FROM worded)),
      sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
      common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
      links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= {percent} * (p.n + q.n - shared)),
      ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
      reached AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reached r JOIN ways w ON w.x = r.y),
      least AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id
    FROM worded LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON x = doc_id"""


def _repeats(size: int = 400, part: int = 200) -> str:
    """Every string of so many bytes, two hexadecimal digits a byte, held against all others."""
    return f"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      cut_up AS (SELECT doc_id, spot, substr(h, 2 * spot + 1, {2 * (part + size - 1)}) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, {part})) AS spot FROM t)),
      strings AS (SELECT doc_id, spot + j AS i, md5_number(substr(h, 2 * j + 1, {2 * size})) AS k
        FROM (SELECT doc_id, spot, h, unnest(range(0, least({part}, len(h) // 2 - {size - 1}))) AS j FROM cut_up)),
      starts AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{size + 1}) > {size} AS fresh
        FROM strings WHERE k IN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1)),
      numbered AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
      spans AS (SELECT doc_id, min(i) AS lo, max(i) + {size} AS hi FROM numbered GROUP BY doc_id, run),
      gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
      cut AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
        string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM t LEFT JOIN cut USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op3_jaccard_join": _linked(),
    "op9_rindex_dedup": _repeats(),
    "op11_ranked_search": _ranking(),
    "op12_license_scan": _licensed(),
    "op13_lloyd_clusters": _clusters(),
    "op10_chat_format": f"""WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
      sized AS (SELECT *, {_escaped("text")} + CASE role WHEN 'user' THEN length('[INST] ') + length(' [/INST]')
        WHEN 'assistant' THEN length(' </s>') WHEN 'system' THEN length('<<SYS>><</SYS>>') + 4
        ELSE length('[ROLE][/ROLE][/TEXT]') + {_escaped("role")} END AS chars FROM turns)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id""",
}
