"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a row of symbols: its words, or single characters in scripts that are written without
spaces. A run of ``k`` symbols is a closed syncmer if the least hash among the runs of ``s`` symbols
inside it is that of the first or the last of them. Whether a run is chosen depends on the run
alone, so an edit changes only the anchors that touch it, and the same passage has the same
anchors in every text, long or short. The fingerprint lists all anchors of a text with their places, in order of
place; an anchor that is repeated counts where it stands first. So its length grows with the text's.

Likeness is positional: anchors that two texts have in common agree if they have moved by about the same number of
symbols, that is, lie in one band of ``drift`` offsets. The likeness is the number of anchors in the best band over the number of
different anchors of both. Passages that are shuffled fall in many bands and count once, a passage that
a long text shares with another one counts wherever it stands.

Defined results: a null text is empty; the fingerprint of an empty text is empty. A text with
fewer than ``k`` symbols has one anchor, the whole text. Two empty fingerprints are alike (1),
an empty and another one are not (0). Ids are integers; rows of one id are ordered by text and sorted
in one task. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from idcordon.functions.sql import name, once


@dataclass(frozen=True)
class SyncmerOptions:
    """drift: symbols by which common anchors may have moved apart and still agree. rows: of a stretch of the order by id."""

    k: int = 5
    s: int = 2
    drift: int = 64
    rows: int = 20000


# Characters of scripts without spaces, and white space.
_ALONE = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}"
_SYMBOL = f"[^ \\t-\\r{_ALONE}]+|[{_ALONE}]"
_PLACE = (1 << 31) - 1  # a packed anchor: 31 bits of hash, a free bit, 31 bits of place


def anchors(df: DataFrame, symbols: str, out: str, options: SyncmerOptions) -> DataFrame:
    """``symbols``, an array, becomes ``out``: position (of the first symbol) and hash of each closed syncmer, in order.

    No symbols or null give null. Each step is evaluated once for a row, behind a one-row generator.
    """
    kept = [name(c) for c in df.columns if c != symbols]
    inner = options.k - options.s  # the last inner run's place in its run
    # Four inner runs: the first and last against those between.
    ends = f"least(g[i], g[i + {inner}])"
    between = ", ".join(f"g[i + {j}]" for j in range(1, inner))
    chosen = f"filter(sequence(0, size(g) - {inner} - 1), i -> {ends} <= {f'least({between})' if inner > 2 else between})"
    mixed = ", ".join(f"h[i + {j}]" for j in range(options.s))
    run = ", ".join(f"g[i + {j}]" for j in sorted({*range(0, inner, options.s), inner}))
    return (
        df.selectExpr(*kept, once(f"transform({name(symbols)}, x -> xxhash64(x))", "h"))
        .selectExpr(*kept, "h", once(f"CASE WHEN size(h) >= {options.k} THEN transform(sequence(0, size(h) - {options.s}), i -> xxhash64({mixed})) END", "g"))
        .selectExpr(
            *kept,
            once(
                "CASE WHEN h IS NULL THEN NULL WHEN g IS NULL THEN array(named_struct('position', 0, 'hash', xxhash64(h))) "
                f"ELSE transform({chosen}, i -> named_struct('position', i, 'hash', xxhash64({run}))) END",
                name(out),
            ),
        )
    )


def sketch(df: DataFrame, text: str, out: str, options: SyncmerOptions) -> DataFrame:
    """Adds ``out``: the distinct anchors of the text, packed, by hash; each with its first place."""
    kept = [name(c) for c in df.columns]
    df = df.selectExpr(*kept, once(f"CASE WHEN {name(text)} <> '' THEN regexp_extract_all({name(text)}, r'{_SYMBOL}', 0) END", "_w"))
    df = df.selectExpr(*kept, "CASE WHEN size(_w) > 0 THEN _w END AS _w")
    df = anchors(df, "_w", "_a", options)
    df = df.selectExpr(*kept, once(f"sort_array(transform(_a, a -> shiftleft(a.hash & {_PLACE}L, 32) | a.position))", "_a"))
    first = "filter(_a, (x, i) -> i = 0 OR shiftright(x, 32) <> shiftright(get(_a, i - 1), 32))"
    return df.selectExpr(*kept, once(f"coalesce({first}, cast(array() AS array<bigint>))", name(out)))


def digits(sketch: str) -> str:
    """The fingerprint: place and eight digits of each anchor, by place."""
    by_place = f"sort_array(transform({sketch}, x -> shiftleft(x & {_PLACE}L, 32) | shiftright(x, 32)))"
    return f"array_join(transform({by_place}, x -> concat(shiftright(x, 32), ':', lpad(lower(hex(x & {_PLACE}L)), 8, '0'))), ' ')"


def with_likeness(df: DataFrame, a: str, b: str, out: str, options: SyncmerOptions) -> DataFrame:
    """Adds ``out``, the likeness of two sketches, 0 to 1."""
    kept = [name(c) for c in df.columns]
    side, half = 1 << 31, options.drift // 2
    # Anchors of both in one sorted row: common ones are neighbours, that of ``a`` first.
    df = df.selectExpr(*kept, once(f"sort_array(concat({a}, transform({b}, x -> x | {side}L)))", "_s"))
    common = "filter(sequence(1, greatest(size(_s) - 1, 1)), i -> shiftright(get(_s, i), 32) = shiftright(get(_s, i - 1), 32))"
    df = df.selectExpr(
        *kept, once(f"sort_array(transform({common}, i -> (get(_s, i) & {_PLACE}L) - (get(_s, i - 1) & {_PLACE}L)))", "_moved")
    )

    def best(shift: int) -> str:
        """Most offsets in one band; the bands of a second grid begin in the middle of those of the first."""
        band = f"CAST(floor((x + {shift}) / {options.drift}) AS BIGINT)"
        run = f"if(m.band = {band}, m.run + 1, 1)"
        return (
            "aggregate(_moved, named_struct('band', CAST(NULL AS BIGINT), 'run', 0, 'best', 0), "
            f"(m, x) -> named_struct('band', {band}, 'run', {run}, 'best', greatest(m.best, {run})), m -> m.best)"
        )

    share = f"CAST(greatest({best(0)}, {best(half)}) AS DOUBLE) / (size({a}) + size({b}) - size(_moved))"
    return df.selectExpr(*kept, once(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1.0D ELSE {share} END", name(out)))


def stretches(docs: DataFrame, options: SyncmerOptions) -> DataFrame:
    """Every row with ``bucket``, its stretch of the order by descending doc_id; ``borrowed`` rows are copies.

    Rows of the same id are ordered by text; a null id comes last. The order is cut into
    stretches by quantiles of the id. Each also gets a copy of the first row of the stretch after
    it (the last one of the first of all), so that no task holds more than a stretch.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n = max(2, min(512, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-ids.count() // options.rows))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted({int(c) for c in cuts})  # one for each bucket
    # Looked up in two steps: the run of bounds, then the bound in it.
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def longs(values: list[int]) -> str:
        return f"cast(array({', '.join(f'{v}L' for v in values)}) AS array<bigint>)"

    run = f"size(filter({longs([r[0] for r in runs])}, b -> b <= doc_id))"
    inner = f"size(filter(get(array({', '.join(map(longs, runs)) or longs([])}), {run} - 1), b -> b <= doc_id))"
    below = f"CASE WHEN {run} = 0 THEN 0 ELSE ({run} - 1) * {step} + {inner} END"
    # Stretch 0 has the largest ids; null ids are in the last one.
    bucket = F.expr(f"CASE WHEN doc_id IS NULL THEN {len(bounds)} ELSE {len(bounds)} - ({below}) END")
    heads = {r[0]: r[1] for r in ids.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id")).collect()}
    order = sorted(heads)
    lent = [(heads[b], order[i - 1]) for i, b in enumerate(order)]  # the first of each to the stretch before it
    firsts = spark.createDataFrame(lent, "head long, to int")
    own = docs.withColumn("bucket", bucket).withColumn("borrowed", F.lit(False))
    others = docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("head")))  # a row for each bucket
    return own.unionByName(others.withColumn("bucket", F.col("to")).withColumn("borrowed", F.lit(True)).drop("head", "to"))


def with_next(parted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``stretches`` with ``next``: the columns of the row that follows; copies are left out."""
    line = Window.partitionBy("bucket").orderBy("borrowed", F.col("doc_id").desc_nulls_last(), "text")
    return parted.withColumn("next", F.lead(F.struct(*columns)).over(line)).where("NOT borrowed").drop("bucket", "borrowed")


def fingerprints(docs: DataFrame, options: SyncmerOptions | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text is the text with its last half replaced by as much of the next document's beginning.
    """
    options = options or SyncmerOptions()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # One shuffle carries the texts; anchors are found behind it.
    rows = sketch(stretches(rows, options).repartition("bucket"), "text", "own", options)
    half = "CAST(length(text) div 2 AS INT)"
    rows = with_next(rows, ["text", "own"]).selectExpr(
        "doc_id", "length(text) AS n_chars", "own", "next.own AS other",
        once(f"concat(substring(text, 1, length(text) - {half}), substring(next.text, 1, {half}))", "edited"),
    )
    rows = sketch(with_likeness(rows, "own", "other", "near_next", options).drop("other"), "edited", "changed", options)
    rows = with_likeness(rows, "own", "changed", "near_edited", options)
    return rows.selectExpr(
        "doc_id", "CAST(n_chars AS BIGINT) AS n_chars", "sha2(edited, 256) AS edited_sha256", f"{digits('own')} AS fingerprint",
        f"{digits('changed')} AS edited_fingerprint", "near_edited", "near_next",
    )
