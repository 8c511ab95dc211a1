"""Ranked search, license scan and centroid clustering against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from idcordon.llm import licenses, lloyd, queries, ranked

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("", "n", "s", "r")]


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(7)
    base = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \t\n--"), (None, base), (None, base), (4, base), (4, base), (5, "É" + base.upper()), (6, "kab"), (7, "ban2É ban2é"),
            (8, prose(rng, 30_000)), (9, "x" * 100_000), (10, "K" * 3 + " license")]
    return rows + [(100 + i, prose(rng, rng.randrange(1, 90))) for i in range(150)]


def with_clashes(spark, rows, schema=DOCS):
    """Extra columns with the names that the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], schema)
    for name in ("score", "rank", "item", "n", "terms", "key", "row", "words", "labels", "part", "size"):
        df = df.withColumn(name, F.lit(name))
    return df


# --- ranked search ----------------------------------------------------------------

def search_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded(text))


def ranked_by_force(docs, items, k=20):
    tfs = [(i, Counter(search_terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n_all, length = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        want, scores = Counter(search_terms(text)), []
        for i, c in tfs:
            m = 75 + (25 * sum(c.values()) * n_all) // length
            s = sum(r * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in want.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "ban bas kar kar tin"), (2, None), (3, ""), (None, "ban"), (4, "nothing-of-this qqq"), (5, "BAN2é tir"), (6, "pan"), (6, "pan")]


@pytest.mark.parametrize("options", [ranked.SearchOptions(), ranked.SearchOptions(k=3, fan=2, shard=200, block=4, first=20), ranked.SearchOptions(vocabulary=0)])
def test_lists_equal_brute_force(spark, odd_rows, options):
    rng = random.Random(3)
    items = ITEMS + [(20 + i, prose(rng, rng.randrange(1, 40))) for i in range(25)]
    docs = with_clashes(spark, odd_rows).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("size", F.lit(1))
    got = ranked.rank_documents(docs, asked, options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_force(odd_rows, items, options.k)


def test_equal_scores_of_a_large_group_go_by_id(spark):
    rows = [(i, "same words here") for i in random.Random(1).sample(range(1000), 700)] + [(5000, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "words other")], "item_id long, text string")
    got = ranked.rank_documents(docs, items, ranked.SearchOptions(first=50)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == sorted(ranked_by_force(rows, [(1, "words other")]), key=lambda r: r[1])


def test_bounds_drop_most_pairs():
    """The trees do what they are for: far fewer pairs are scored than there are, and no list changes."""
    rng = random.Random(2)
    bags = [Counter(rng.choices(range(2, 500), k=40)) for _ in range(600)]
    asked = [Counter(rng.choices(range(2, 500), k=12)) for _ in range(40)]
    df = Counter(t for b in bags for t in b)
    weights = {t: math.floor(1000 * math.log(1202 / (2 * n + 1))) for t, n in df.items()}

    def packed(c):
        keys = sorted(c)
        return np.array(keys, "<u8").tobytes(), np.array([c[t] for t in keys], "<u4").tobytes()

    options = ranked.SearchOptions(k=3)
    items = ranked.Items([packed(c) for c in asked], weights, options)
    search = ranked.Search(items, np.zeros(40, dtype=np.int64))
    search.shard(list(range(600)), np.full(600, 40), [packed(b) for b in bags], 600, 24_000)
    assert search.compared < 0.5 * 600 * 40
    m = 75 + 25
    for item, c in enumerate(asked):
        scores = sorted(((-sum(r * weights.get(t, 0) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, r in c.items() if b[t]), i) for i, b in enumerate(bags)))[:3]
        assert sorted((-s, i) for i_, i, s in search.found() if i_ == item) == sorted((s, i) for s, i in scores if s)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank_documents(docs, items).collect() == []
    full = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked.rank_documents(full, items.where("false")).collect() == []
    assert ranked.rank_documents(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


# --- license scan -----------------------------------------------------------------

def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def licenses_by_force(text, options):
    words = license_words(text)
    hits = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    found, share = set(), 0.0
    sets = [(label, licenses.stride(t, options), set(license_words(t))) for label, t in options.templates]
    for s in {s for _, s, _ in sets}:
        for at in range(0, len(words), s):
            block = set(words[at : at + 2 * s])
            held = [(label, t) for label, own, t in sets if own == s and 100 * len(block & t) >= options.percent * len(t)]
            for label, t in held:
                if not any(label != b and t < u for b, u in held):
                    found.add(label)
                    share = max(share, len(block & t) / len(t))
    base = sorted({x for _, x in hits})
    places = [i for i, _ in hits]
    return (len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *found})), 1.0 if hits else share)


@pytest.mark.parametrize("percent", [90, 60])
def test_licenses_equal_brute_force(spark, odd_rows, percent):
    rng = random.Random(11)
    options = licenses.LicenseOptions(percent=percent)
    rows = list(odd_rows) + [(20, "MIT-License and the mit  license; Apache\nLicense"), (20, "MIT-License and the mit  license; Apache\nLicense"), (21, "mit licenses, submit license"),
                             (22, "general public apache license mitKense")]
    for j, (_, template) in enumerate(options.templates):
        words = template.split()
        lost = words[:]
        del lost[rng.randrange(len(lost))]
        for body in (words, lost, words[::-1]):
            rows.append((200 + j, f"{prose(rng, rng.randrange(0, 70))} {' '.join(body).upper()} {prose(rng, rng.randrange(0, 70))}"))
    got = licenses.scan(with_clashes(spark, rows).repartition(3), options)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = Counter(str((i, *licenses_by_force(t, options))) for i, t in rows)
    assert Counter(str(tuple(r)) for r in got.collect()) == want
    assert sum("cc-by" in w for w in want) > 3


def test_scan_runs_no_python_and_takes_an_empty_table(spark):
    none = licenses.scan(spark.createDataFrame([], DOCS))
    assert none.collect() == []
    plan = licenses.scan(spark.createDataFrame([(1, "MIT license")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_no_templates(spark):
    docs = spark.createDataFrame([(1, "the MIT license")], "doc_id long, text string")
    got = licenses.scan(docs, licenses.LicenseOptions(templates=())).collect()
    assert [tuple(r) for r in got] == [(1, 3, 1, 1, 1, "mit", "mit", 1.0)]


# --- clustering -------------------------------------------------------------------

def lloyd_by_force(rows, options):
    kept = [(i, [math.floor(options.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == options.dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[: options.k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(options.rounds):
        to = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, to) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    to = assign()
    inertia = Counter()
    for far, c in to:
        inertia[c] += far
    return [(i, c, far, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (far, c) in zip(kept, to)]


def vectors(n, dims, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.uniform(-2, 2)]) for _ in range(dims)]) for i in range(n)]
    bad = [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims + 1)), (904, [None] + [1.0] * (dims - 1)), (905, [float("nan")] * dims), (906, [float("inf")] + [0.0] * (dims - 1))]
    return rows + bad + rows[:3] + [(None, rows[0][1]), (None, rows[5][1])]


@pytest.mark.parametrize("options", [lloyd.LloydOptions(k=5, dims=8, shards=3, rows=7), lloyd.LloydOptions(k=4, dims=1, rounds=2), lloyd.LloydOptions(k=200, dims=3, scale=2, shards=9), lloyd.LloydOptions(k=3, dims=4, rounds=0)])
def test_clusters_equal_brute_force(spark, options):
    rows = vectors(60, options.dims)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(0)).repartition(3)
    got = lloyd.report(*lloyd.cluster(table, options))
    assert Counter(map(tuple, got.collect())) == Counter(lloyd_by_force(rows, options))


def test_clusters_of_few_and_no_vectors(spark):
    options = lloyd.LloydOptions(dims=2)
    one = spark.createDataFrame([(7, [0.25, -0.01])], "vec_id long, embedding array<float>")
    row = lloyd.report(*lloyd.cluster(one, options)).collect()
    assert [tuple(r) for r in row] == [(7, 0, 0, 0, 0, hashlib.sha256(b"16,-1").hexdigest())]
    assert lloyd.report(*lloyd.cluster(one.where("false"), options)).collect() == []


def test_components_too_large_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="after scaling"):
        lloyd.cluster(table, lloyd.LloydOptions(dims=2))


def test_registered_queries_on_the_whole_tables(spark):
    docs, items, vecs = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark", "embeddings"))
    got = sorted(map(tuple, queries.op11_ranked_search(spark, SF).collect()), key=str)
    assert got == ranked_by_force([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    want = Counter(str((r.doc_id, *licenses_by_force(r.text, licenses.LicenseOptions()))) for r in docs)
    assert Counter(str(tuple(r)) for r in queries.op12_license_scan(spark, SF).collect()) == want
    want = Counter(lloyd_by_force([(r.vec_id, r.embedding) for r in vecs], lloyd.LloydOptions()))
    assert Counter(map(tuple, queries.op13_lloyd_clusters(spark, SF).collect())) == want
