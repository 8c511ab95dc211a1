"""What operators leave in the shared folder, and how often whole rows are shuffled."""

from __future__ import annotations

import contextlib
import io
import os
import re
from collections import Counter

import numpy as np
from idcordon.llm import mix, rindex, setjoin
from idcordon.sources import shared
from pyspark.sql import functions as F
from tests.llm.test_operators import repeats_by_force

DOCS = "doc_id long, text string, source string, tag string"


def left_by(spark, make):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    df = make()
    return df, sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before)


def documents(spark):
    words = [f"w{i * 7919 % 613}" for i in range(900)]
    rows = [(i, " ".join(words[i : i + 200]), f"s{i % 2}", "a") for i in range(0, 600, 60)]
    rows += [(9, "one two three", "s0", tag) for tag in "abcde"] + [(10, None, None, "a"), (11, "", "s1", "a")]
    return spark.createDataFrame(rows, DOCS)


def test_tables_go_once_their_product_is_stored(spark):
    docs = documents(spark)
    once = shared.settled(lambda: shared.stored(spark.range(5), "inner").where("id > 1"), "outer")
    assert once.count() == 3
    for make, name in ((lambda: rindex.without_repeats(docs), "spans"), (lambda: setjoin.one_of_each(docs), "affected")):
        df, names = left_by(spark, make)
        assert names == [name]
        assert df.count() > 0
    _, names = left_by(spark, lambda: shared.settled(lambda: shared.settled(lambda: shared.stored(spark.range(3), "a"), "b"), "c"))
    assert names == ["c"]


def test_the_mix_shuffles_whole_rows_once(spark):
    docs = documents(spark)
    rows = mix.taken(mix.mix(docs, extra=True))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        rows.explain("formatted")
    exchanges = re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: (.*)", out.getvalue())
    assert sum("text#" in x for x in exchanges) == 1
    narrow = mix.taken(mix.mix(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")
    got = rows.select(*narrow.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, narrow.collect()))
    assert sorted(r.tag for r in rows.where("doc_id = 9").collect()) == list("abcde")


def test_only_texts_with_repeats_are_shuffled(spark):
    docs = documents(spark).where("doc_id > 100 OR doc_id < 5").unionByName(documents(spark).where("doc_id = 11"))
    likely, hit = rindex.sifted(rindex._hashed(docs), "h1", rindex.repeat_spans(docs), "h1", 1 << 24)
    want = {r.doc_id for r in rindex.removal_digests(docs).where("n_removed > 0").collect()}
    assert want and {r.doc_id for r in likely.where(hit).collect()} == want
    assert likely.where(F.expr("text = ''")).where(~hit).count() == 1


def test_frequent_anchors_are_spread(spark):
    assert rindex.nth(np.array([5, 3, 5, 5, 3], dtype=np.uint64)).tolist() == [0, 0, 1, 2, 1]
    assert rindex.nth(np.zeros(0, dtype=np.uint64)).tolist() == []
    passage = " ".join(f"v{i * 31 % 97}" for i in range(200))
    rows = [(i, f"begin{i} {passage} end{i}") for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string").repartition(3)
    options = rindex.RepeatOptions()
    anchors = rindex._anchors(rindex._hashed(docs), options)
    groups = anchors.groupBy("anchor", "part").count().agg(F.max("count")).first()[0]
    assert anchors.groupBy("anchor").count().agg(F.max("count")).first()[0] >= 300 and groups <= 6
    found = rindex._repeated(anchors)
    assert found.groupBy("h1", "h2", "place").count().where("count > 1").count() == 0
    assert found.select("h1", "h2").distinct().count() == 300
    got = rindex.removal_digests(docs).collect()
    assert Counter(tuple(r)[1:] for r in got) == Counter(repeats_by_force([t.encode() for _, t in rows + rows[:40]], options.length))
