"""License scans by an exact set-similarity join, with DataFrame functions only.

A text is a row of words. A template is a set of words, and has a stride, the least power of two that is no
less than its length in words and ``shortest``. The blocks that are held against it are windows of twice its
stride, one at each multiple of the stride, so that every passage of the template's length lies whole in one of them. A
block holds a template if it has ``percent`` per cent of the template's words at least (containment).

Words of templates are ordered by the number of documents that hold them, rare ones first. A template
of n words of which a block must have m shares one of its first n - m + 1 words with each block that
holds it (prefix filter), and so does the block with its own first words. Only windows around such a
word are made; blocks with fewer than m template words (length filter), and pairs whose words after the
first common one don't suffice (positional filter), are dropped before sets are compared. No block that
reaches the threshold is lost. Of two templates of different labels and one stride that a block holds, one
with all words of the other and more, the larger one counts.

Defined results: a null text is empty and has no words. Repeated rows each get their own result. A
null id is kept. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idcordon.functions.sql import array, let, lit, once
from idcordon.sources.shared import stored

# Phrases of the base labels, as words.
PHRASES = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}

# Sentences by which works state their license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"
_MOST_WORDS = 100_000
_MOST_SENT = 50_000


@dataclass(frozen=True)
class LicenseOptions:
    """percent: of a template's words that a block must have. shortest: the least stride."""

    templates: Sequence[tuple[str, str]] = TEMPLATES
    percent: int = 90
    shortest: int = 8


def _spelled(text: str) -> list[str]:
    """The words of a template, which is ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_words(text: str) -> list[str]:
    """The distinct words of a template."""
    return list(dict.fromkeys(_spelled(text)))


def stride(text: str, options: LicenseOptions) -> int:
    """Words from one block to the next; blocks are twice as long."""
    return 1 << (max(len(_spelled(text)), options.shortest) - 1).bit_length()


def needed(n: int, percent: int) -> int:
    """How many of n words a block must have."""
    return -(-n * percent // 100)


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text`` becomes ``words``, with A-Z lower-cased. Texts of ASCII only take the shorter way to the same words."""
    t = f"coalesce({text}, '')"
    lowered = f"if(octet_length(t) = length(t), lower(t), translate(t, '{_UPPER}', '{_LOWER}'))"
    return docs.selectExpr(*[c for c in docs.columns if c != text], once(f"array_remove(split({let(t, 't', lowered)}, '{_GAPS}'), '')", "words"))


def word_order(worded: DataFrame, options: LicenseOptions) -> list[str]:
    """The templates' words, those that the fewest documents hold first. As many numbers reach the driver."""
    vocabulary = sorted({w for _, text in options.templates for w in template_words(text)})
    if len(vocabulary) > _MOST_WORDS:
        raise ValueError(f"the templates have over {_MOST_WORDS} words")
    held = worded.select(F.explode(F.expr(f"array_intersect({array(vocabulary)}, words)")).alias("word"))
    count = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def base_columns(worded: DataFrame) -> DataFrame:
    """Adds n_words and ``_hits``: start and label of every place of a phrase, in order."""
    cases = []
    for label, phrase in PHRASES.items():
        *before, end = phrase.split()  # the word x at i may be the phrase's last one
        back = len(before)
        test = " AND ".join([f"x = {lit(end)}", *(f"get(words, i - {back - j}) = {lit(w)}" for j, w in enumerate(before))])
        cases.append(f"WHEN {test} THEN named_struct('at', cast(i - {back} AS bigint), 'label', {lit(label)})")
    last = array(sorted({p.split()[-1] for p in PHRASES.values()}))
    hits = f"filter(transform(words, (x, i) -> CASE {' '.join(cases)} END), h -> h IS NOT NULL)"
    none = "cast(array() AS array<struct<at:bigint,label:string>>)"
    return worded.selectExpr("*", "cast(size(words) AS bigint) AS n_words", once(f"if(arrays_overlap(words, {last}), {hits}, {none})", "_hits"))


def prefixes(order: list[str], options: LicenseOptions) -> list[tuple]:
    """(template, label, stride, words, n, m, place, word) of each word of each template's prefix."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for i, (label, text) in enumerate(options.templates):
        words = sorted(template_words(text), key=rank.__getitem__)
        m = needed(len(words), options.percent)
        out += [(i, label, stride(text, options), words, len(words), m, place, words[place]) for place in range(len(words) - m + 1)]
    return out


_BLOCKS = "cast(array() AS array<struct<stride:int,no:bigint,words:array<string>>>)"


def with_blocks(worded: DataFrame, order: list[str], index: list[tuple]) -> DataFrame:
    """``words`` become ``_blocks``: of windows that hold a prefix word of a template of their stride, the template words in order."""
    parts = []
    for s in sorted({x[2] for x in index}):
        first = array(sorted({x[7] for x in index if x[2] == s}))
        near = f"transform(words, (x, i) -> if(array_contains({first}, x), array(greatest(i div {s} - 1, 0), i div {s}), NULL))"
        windows = f"array_distinct(flatten(filter({near}, w -> w IS NOT NULL)))"
        # A text's words are looked up where they stand; of a window only its template words go on.
        inside = f"array_intersect({array(order)}, slice(words, cast(b * {s} + 1 AS int), {2 * s}))"
        blocks = f"transform({windows}, b -> named_struct('stride', {s}, 'no', b, 'words', {inside}))"
        parts.append(f"if(arrays_overlap(words, {first}), {blocks}, {_BLOCKS})")
    kept = [c for c in worded.columns if c != "words"]
    return worded.selectExpr(*kept, once(f"concat({', '.join(parts) or _BLOCKS})", "_blocks"))


def larger_templates(options: LicenseOptions) -> list[list[int]]:
    """For each template those of its stride and another label that have all of its words and more."""
    sets = [(label, stride(text, options), set(template_words(text))) for label, text in options.templates]
    return [[j for j, (b, t, y) in enumerate(sets) if a != b and s == t and x < y] for a, s, x in sets]


def matches(parted: DataFrame, index: list[tuple], options: LicenseOptions) -> DataFrame:
    """(row, label, share) of each template that a block of the row's text holds.

    The prefix words of blocks meet those of templates in an equi-join.
    """
    larger = larger_templates(options)
    templates = parted.sparkSession.createDataFrame(
        [(*x, larger[x[0]]) for x in index],
        "template int, label string, stride int, t_words array<string>, n int, m int, t_place int, word string, larger array<int>",
    )
    if len(index) <= _MOST_SENT:  # more are joined by shuffle
        templates = F.broadcast(templates)
    least = min((x[5] for x in index), default=1)
    blocks = parted.select("row", F.explode("_blocks").alias("b")).select("row", "b.stride", "b.no", "b.words").where(F.size("words") >= least)
    # Place j of a block of s words is in its prefix for m if j <= s - m.
    placed = blocks.select("row", "stride", "no", "words", F.posexplode(F.expr(f"slice(words, 1, size(words) - {least} + 1)")).alias("place", "word"))
    met = placed.join(templates, ["word", "stride"]).where(
        "size(words) >= m AND place <= size(words) - m AND 1 + least(n - 1 - t_place, size(words) - 1 - place) >= m"
    )
    held = met.withColumn("common", F.size(F.array_intersect("words", "t_words"))).where("common >= m")
    of_block = held.groupBy("row", "stride", "no").agg(F.expr("collect_set(struct(template, label, common / n AS share, larger))").alias("held"))
    kept = of_block.select("row", F.explode(F.expr("filter(held, h -> NOT arrays_overlap(h.larger, held.template))")).alias("h"))
    return kept.select("row", "h.label", "h.share")


def scan(docs: DataFrame, options: LicenseOptions | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    labels: the base ones and those of held templates; score: 1 with a base phrase, else the largest share
    of a held template's words found in one block, else 0.
    """
    options = options or LicenseOptions()
    worded = with_words(docs.select("doc_id", "text"))
    order = word_order(worded, options)
    index = prefixes(order, options)
    parted = with_blocks(base_columns(worded), order, index).withColumn("row", F.monotonically_increasing_id())
    parted = stored(parted, "licenses")
    found = matches(parted, index, options).groupBy("row").agg(F.collect_set("label").alias("_found"), F.max("share").alias("_share"))
    none = "cast(array() AS array<string>)"
    base = "array_sort(array_distinct(_hits.label))"
    return parted.drop("_blocks").join(found, "row", "left").selectExpr(
        "doc_id", "n_words", "cast(size(_hits) AS bigint) AS n_base", "array_min(_hits.at) AS first_word", "array_max(_hits.at) AS last_word",
        f"array_join({base}, ',') AS base_labels",
        f"array_join(array_sort(array_union(_hits.label, coalesce(_found, {none}))), ',') AS labels",
        "CASE WHEN size(_hits) > 0 THEN 1.0D ELSE coalesce(_share, 0.0D) END AS score",
    )
