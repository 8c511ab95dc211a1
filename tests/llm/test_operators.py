"""The ten operators against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from idcordon.llm import chat, ctw, decontam, html, mix, quality, queries, rindex, setjoin, syncmers, toxicity
from idcordon.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("", "n", "s", "r")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids and sources, ties, repeated rows, a very long text; and ordinary ones."""
    rng = random.Random(5)
    base = prose(rng, 120)
    edited = base.split()
    edited[40] = "other"
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n", "en", "a", 3), (None, base, "en", None, 5), (4, base, "en", "b", 5),
            (4, base, "en", "b", 5), (4, base, "en", "b", 5), (5, " ".join(edited), "de", "b", 9), (6, "one two", "en", "b", 7), (7, "ONE  two", "en", "c", 7),
            (8, prose(rng, 60_000), "en", "c", 10**9), (9, "x" * 200_000, "en", "c", -1), (9, "é\U0001f600 " * 300, "en", "é", 4)]
    rows += [(100 + i, prose(rng, rng.randrange(1, 90)), "en", f"s{i % 3}", 100) for i in range(60)]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("key", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard_by_force(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        groups[find(a)].append(i)
    least = {g: min((i for i in v if i is not None), default=None) for g, v in groups.items()}
    return sorted(((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets)), key=repr)


def near_copies(seed):
    """Groups of edited copies, chains of small sets, a passage that many texts share."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 40)
    for _ in range(8):
        base = prose(rng, rng.randrange(5, 120)).split()
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [copy[k], "added"]])
            rows.append(" ".join(copy))
    rows += [f"{prose(rng, rng.randrange(5, 60))} {passage}" for _ in range(40)]
    rows += [prose(rng, rng.randrange(1, 9)) for _ in range(60)]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_is_exact(spark, seed):
    rows = near_copies(seed)
    options = setjoin.JaccardOptions(part=4, crowd=3, count_shingles=500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, setjoin.jaccard_components(df, options).collect()), key=repr) == jaccard_by_force(rows)


def test_light_sets_meet_by_subsets_and_heavy_ones_in_lists():
    options = setjoin.JaccardOptions()
    sizes = {n: 100 for n in range(1, 65)}
    assert setjoin.boundary(sizes, 0.0, options) < setjoin.boundary(sizes, 50.0, options)


def test_jaccard_join_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = setjoin.jaccard_components(odd).collect()
    assert sorted(map(tuple, got), key=repr) == jaccard_by_force(rows)
    assert setjoin.jaccard_components(none).count() == 0
    left = setjoin.one_of_each(odd)
    assert left.columns == odd.columns
    kept = left.collect()
    assert len([r for r in kept if not words(r.text)]) == 3
    assert Counter(c for _, n, c in jaccard_by_force([(r.doc_id, r.text) for r in kept]) if n).most_common(1)[0][1] <= 2  # id 9 twice
    assert {r.doc_id for r in kept if r.text and len(words(r.text)) == 120} == {None}  # the smallest id: null first
    assert setjoin.one_of_each(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- mix


def test_mix_meets_its_targets(spark, odd, none):
    rows = mix.taken(mix.mix(odd, extra=True))
    assert set(odd.columns) | {"source_size", "target", "taken"} == set(rows.columns)
    got = rows.collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(words(r.text)) and r.taken <= 2 * r["size"]
        by[r.source].append(r)
    for own in by.values():
        assert own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    again = mix.taken(mix.mix(odd)).collect()
    assert sorted((repr(r.doc_id), r.taken) for r in again) == sorted((repr(r.doc_id), r.taken) for r in got)
    assert mix.taken(mix.mix(none)).count() == 0


def test_targets_stop_at_twice_the_size():
    options = mix.MixOptions()
    got = mix.targets([100, 10, 1000, 0], options)
    assert got[:2] == [200.0, 20.0] and got[3] == 0 and math.isclose(sum(got), 1665)


def test_schedule_ranks():
    schedule = mix.Schedule([3, 1, 2, 0.5], 1000)
    import numpy as np

    slots = np.arange(1000)
    source = schedule.source(slots)
    rank = schedule.rank(slots, source)
    seen = Counter()
    for s, r in zip(source.tolist(), rank.tolist()):
        assert seen[s] == r
        seen[s] += 1
    assert [seen[k] for k in range(4)] == schedule.totals().tolist()
    assert all(abs(seen[k] - 1000 * w / 6.5) < 6 for k, w in enumerate([3, 1, 2, 0.5]))


# ---------------------------------------------------------------- repeats


def repeats_by_force(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("label_bytes", [1 << 22, 1])
def test_repeats_are_exact(spark, label_bytes):
    rng = random.Random(9)
    shared = [prose(rng, 30) for _ in range(4)]
    texts = [None, "", "short", "ab" * 90, "é" * 60]
    texts += [" ".join(rng.choice([prose(rng, 12), rng.choice(shared)]) for _ in range(6)) for _ in range(30)]
    texts += [texts[7], texts[8] + "!"]
    options = rindex.RepeatOptions(length=50, anchor=24, near=3, label_bytes=label_bytes, index_bytes=2000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in rindex.removal_digests(df, options).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_by_force([(t or "").encode() for t in texts], 50)


def test_run_index_gives_all_match_lengths():
    rng = random.Random(2)
    for _ in range(20):
        segments = list(dict.fromkeys(bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 30))) for _ in range(6)))
        count = Counter(s[i : i + 5] for s in segments for i in range(len(s) - 4))
        for s, got in zip(segments, rindex.repeated_windows(segments, 5)):
            assert got.tolist() == [count[s[i : i + 5]] > 1 for i in range(len(s) - 4)]


def test_repeats_of_odd_rows(spark, odd, none):
    rows = odd.collect()
    got = rindex.removal_digests(odd).collect()
    want = repeats_by_force([(r.text or "").encode() for r in rows], 400)
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    cut = rindex.without_repeats(odd)
    assert cut.columns == [*odd.columns, "n_removed"] and cut.count() == odd.count()
    assert rindex.removal_digests(none).count() == 0 and rindex.without_repeats(none).count() == 0


# ---------------------------------------------------------------- benchmark


def test_leaks_are_found_and_clean_rows_left(spark, odd, none):
    rng = random.Random(4)
    items = [(k, prose(rng, 35)) for k in range(12)] + [(50, None), (51, ""), (52, "two words")]
    rows = [(k, prose(rng, 300)) for k in range(40)]
    for k in range(6):  # whole; punctuated; with words changed, left out, put in
        w = items[k][1].split()
        if k >= 2:
            for j in range(3, 35, 6):
                w[j] = rng.choice(["", "changed", w[j] + " added"])
        rows.append((100 + k, f"{prose(rng, 50)} {', '.join(w) if k == 1 else ' '.join(w).upper()} {prose(rng, 50)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 22, 400):
        got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(df, bench, decontam.LeakOptions(slice_bytes=size)).collect()}
        assert set(got) == {(100 + k, k) for k in range(6)} and got[100, 0] == 1.0 == got[101, 1]
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == set(range(40))
    assert decontam.clean(odd, bench).columns == odd.columns and decontam.clean(odd, bench).count() == odd.count()
    assert decontam.leaks(none, bench).count() == 0
    assert decontam.leaks(df, bench.where("false")).count() == 0 and decontam.clean(df, bench.where("false")).count() == len(rows)


@pytest.mark.parametrize("every", [4, 5])
@pytest.mark.parametrize("exact", [False, True])
def test_copies_with_few_grams_left_are_found(spark, every, exact):
    rng = random.Random(every)
    items = [(k, prose(rng, 35)) for k in range(8)]
    rows = [(k, prose(rng, 300)) for k in range(20)]
    for k, text in items:
        w = text.split()
        w[every - 1 :: every] = ["changed"] * len(w[every - 1 :: every])
        rows.append((100 + k, f"{prose(rng, 50)} {' '.join(w)} {prose(rng, 50)}"))
        rows += [(200 + k, f"{prose(rng, 20)} {text}")] if exact else []
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(100 + k, k) for k in range(8)} | ({(200 + k, k) for k in range(8)} if exact else set())
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == want
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == set(range(20))


def test_alignment_is_smith_waterman():
    import numpy as np

    rng, o = random.Random(8), decontam.LeakOptions()
    pairs = [([rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(1, 12))]) for _ in range(40)]
    got, _ = decontam.align([np.array(a, dtype=np.uint64) for a, _ in pairs], [np.array(b, dtype=np.uint64) for _, b in pairs], o)
    for (a, b), score in zip(pairs, got):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (o.match if x == y else -o.mismatch), h[i - 1][j] - o.gap, h[i][j - 1] - o.gap)
        assert score == max(map(max, h))


# ---------------------------------------------------------------- classifiers


def test_quality_separates_held_out_rows(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 3 <> 0")
    model = quality.train(docs, fit)
    rows = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    wrong = [r for r in rows if r.keep != (r.quality == 1)]
    assert len(wrong) <= 0.02 * len(rows)
    kept = quality.kept(odd, model)
    assert kept.columns == odd.columns and quality.score(odd, model).count() == odd.count()
    assert quality.score(none, quality.train(none, fit)).count() == 0
    one_kind = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, one_kind).collect()} == {0.5} and quality.kept(docs, one_kind).count() == docs.count()


def test_toxicity_on_held_out_rows(spark, odd, none):
    rows = queries.op6_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.85 * len(rows)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(none, toxicity.train(none, labels, F.lit(True))).count() == 0


def test_toxicity_keeps_every_string_of_its_sample(spark):
    rng = random.Random(11)
    rows = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz \u0436\u044f", k=150_000))) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    model = toxicity.train(df, labels, F.lit(True), toxicity.ToxicityOptions(fit_documents=0))
    seen = set()
    for _, text in rows:
        data = b"\0" * 5 + text.encode() + b"\xff"
        seen.update(data[i : i + 6] for i in range(len(data) - 5))
    assert len(seen) > 1_000_000 and model.codes[-1].tolist() == sorted(int.from_bytes(x, "big") for x in seen)


def test_word_scores_by_force_and_a_proper_model(spark, odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    got = ctw.score(odd, held, ctw.ScoreOptions(nodes=4000, common_words=50)).collect()
    count = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words(t), None])
    total, distinct = sum(count.values()), len(count)
    want = defaultdict(list)
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        want[i].append((len(w), sum(count[x] > 0 for x in w), round(base, 3)))
    have = defaultdict(list)
    for r in got:
        assert r.train_tokens == total and r.score < 0
        have[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 3)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert ctw.score(none, held).count() == 0
    assert ctw.score(odd.where("doc_id = 6"), F.lit(True)).first().score == pytest.approx(-8 * 8 * math.log10(2))


def test_tree_predictions_add_up_to_one():
    import numpy as np

    from idcordon.llm import words as w

    text = (b"the cat sat on the mat and the dog sat on the cat ") * 9
    block = w.Block(0, np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    levels = []
    code, _ = ctw.strings(block, 3)
    for d in range(4):
        value, n = np.unique(code & np.uint64((1 << (8 * (d + 1))) - 1), return_counts=True)
        levels.append((value, n.astype(float)))
    scorer = ctw.Scorer(ctw.build_tree(levels))
    for context in (b"the", b"sat", b"xyz", b"\0\0t", b"qat"):
        base = sum(c << (8 * (k + 1)) for k, c in enumerate(reversed(context)))
        every = np.array([base | b for b in range(256)], dtype=np.uint64)
        assert np.isclose((10 ** scorer.bytes_logp(every)).sum(), 1, atol=1e-4)


# ---------------------------------------------------------------- pages, fingerprints, chat


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice"><p>We use cookies, many of them, yes, and so on and on.</div>
<div class="content"><h1>The title</h1><p>First paragraph, with commas,\n and <b>bold &amp; plain</b> text, long enough to count.<p>Second one&hellip; with
<a href="x">a link</a>, and more text that follows it, so that it counts.<!-- hidden --><form><p>Your name, your mail, your message, all of it here</form></div>
<aside><p>Related things, other things, more things, and yet more of them.</p></aside><div class="comments"><p>Great, really great, I liked it, thanks for all of it!</p></div>
<footer>&copy; all</footer>"""


def test_article_text(spark):
    want = ["The title", "First paragraph, with commas, and bold & plain text, long enough to count.", "Second one… with a link, and more text that follows it, so that it counts."]
    assert html.main_text(PAGE) == "\n\n".join(want)
    assert [html.main_text(x) for x in (None, "", "  ", "<script>x", "plain", "<p>a<br>b", "</p></div>")] == ["", "", "", "", "plain", "a b", ""]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = html.extract(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 5 * 50_000 - 1
    assert html.extract(df.where("false")).count() == 0


def sentence(rng, n=18):
    return ", ".join(" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(n // 6)) + "."


LINKS = "".join(f"<li><a href='/{i}'>Some link text number {i}</a></li>" for i in range(12))
CLUTTER = {
    "menu": f"<div class='top-menu'><ul>{LINKS}</ul></div>", "nav": f"<nav><ul>{LINKS}</ul></nav>", "links": f"<ul>{LINKS}</ul>",
    "side": f"<div id='sidebar'><p>Read on, there is more, much more, of all kinds of things.</p><ul>{LINKS}</ul></div>",
    "cookie": "<div class='cookie-notice'><p>We use cookies, many of them, for this, that, and more of it all the time.</p></div>",
    "ad": "<div class='ad-box'><p>Buy this now, it is cheap, it is good, and it is nearly gone, so hurry up.</p></div>",
    "comments": "<div id='comments'><p>I liked this, really, it was good, and I read all of it, twice.</p><p>So did I, yes, all of it, and more than twice.</p></div>",
    "footer": "<footer><p>All rights reserved, by us, for ever, in every land and on every sea.</p></footer>",
    "foot": "<div class='site-footer'><p>All rights reserved, by us, for ever, in every land and on every sea.</p></div>",
    "form": "<form><p>Your name, your mail, your message, all of it here, please, thanks.</p><input></form>",
    "header": "<header><h2>The site</h2><p>The site of all sites, and of much else besides that.</p></header>",
}


def page_shapes():
    """Pages without an article or main element: blocks of text in order, and the page."""
    rng = random.Random(77)

    def ps(n):
        return [sentence(rng, 6 * rng.randrange(4, 9)) for _ in range(n)]

    def p(texts):
        return "".join(f"<p>{t}</p>" for t in texts)

    c = CLUTTER
    for before, after in ((["menu", "cookie"], ["footer"]), (["header", "nav"], ["comments", "foot"])):
        t = ps(5)
        yield t, "".join(c[x] for x in before) + f"<div class='content'>{p(t)}</div>" + "".join(c[x] for x in after)
        yield t, "".join(c[x] for x in before) + f"<div><div><div>{p(t)}</div></div></div>" + "".join(c[x] for x in after)
        yield t, "".join(c[x] for x in before) + p(t) + "".join(c[x] for x in after)  # in the body itself
        yield t, f"<table><tr><td>{c['links']}</td><td>{p(t)}</td></tr></table>" + "".join(c[x] for x in after)
        yield t, f"<div class='page'>{c['side']}<div id='text'>{p(t[:2])}{c['ad']}{p(t[2:])}</div></div>"
        yield t, f"<section><h2>{t[0]}</h2>{p(t[1:])}{c['form']}</section>" + c["links"]
        yield t, f"<div class='story'><h1>{t[0]}</h1>{p(t[1:3])}<blockquote>{p(t[3:])}</blockquote></div>" + c["side"]
        yield t, f"<div class='x'>{p(t[:2])}<div class='side-effects'>{p(t[2:4])}</div>{p(t[4:])}{c['comments']}</div>"
        yield t, f"{c['nav']}<div class='post'>{p(t[:1])}<ul>{''.join(f'<li>{x}</li>' for x in t[1:])}</ul></div>{c['foot']}"
        yield t, f"{c['menu']}<div class='entry'>{p(t[:4])}<div class='comment-period'><ul>{LINKS}</ul></div>{p(t[4:])}</div>{c['footer']}"


def test_twenty_shapes_of_pages():
    shapes = list(page_shapes())
    assert len(shapes) == 20
    for k, (want, page) in enumerate(shapes):
        assert html.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == "\n\n".join(want), k


@pytest.mark.parametrize("name", ["side-effects", "share-price", "menu-of-the-day", "comment-period", "head-injury", "hidden-costs"])
def test_names_alone_take_nothing_out_of_an_article(name):
    rng = random.Random(3)
    a, b, d = sentence(rng), sentence(rng), "Short one."
    page = f"<body><nav>x</nav><article><h1>T</h1><p>{a}</p><section class='{name}'><p>{b}</p><p>{d}</p></section><div class='ad'>{b}</div></article></body>"
    assert html.main_text(page) == "\n\n".join(["T", a, b, d])


def test_scores_decide_between_containers():
    rng = random.Random(4)
    text = [sentence(rng, 48) for _ in range(6)]
    body = "".join(f"<p>{t}</p>" for t in text)
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>{sentence(rng, 6)}</p></article>" for i in range(5))
    assert html.main_text(f"<div>{teasers}</div><div class='text'>{body}</div>") == "\n\n".join(text)
    # Equal containers: the first one in the page; its neighbour has as many points and stays too.
    assert html.main_text(f"<div><p>{text[0]}</p></div><div><p>{text[0]}</p></div>") == f"{text[0]}\n\n{text[0]}"
    # A page that has nothing but what is left out by name.
    assert html.main_text(f"<div class='comments'>{body}</div>") == "\n\n".join(text)


def test_fingerprints(spark, odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = syncmers.fingerprints(odd).collect()
    assert len(got) == len(rows)
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for k, (i, t) in enumerate(line):
        other, half = line[(k + 1) % len(line)][1], len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert len({r.fingerprint for r in got if r.doc_id == 4 or r.doc_id is None}) == 1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    long = [r for r in got if r.n_chars > 200 and r.doc_id and r.doc_id >= 100]
    assert sum(r.near_edited for r in long) > 10 * sum(r.near_next for r in long)
    assert syncmers.fingerprints(none).count() == 0
    assert syncmers.fingerprints(odd.where("doc_id = 6")).first().near_next == 1.0


def test_texts_of_few_and_of_more_words_are_compared(spark):
    base = prose(random.Random(3), 40).split()
    rows = [(5, " ".join(base[:32])), (4, " ".join(base[:31])), (3, " ".join(base)), (2, ""), (1, " ".join(base[:10])), (0, " ".join(base[:9]))]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5].near_next > 0.8 and got[4].near_next > 0.5  # 32 and 31 words, 31 and 40 words
    assert got[3].near_edited > 0.3  # half of 40 words is left
    assert got[1].near_next > 0.7  # both of few words
    assert got[2].fingerprint == "" and got[2].near_next == 0.0
    assert all(re.fullmatch(r"\d+:[0-9a-f]{8}( \d+:[0-9a-f]{8})*", got[i].fingerprint) for i in (0, 1, 3, 4, 5))  # one kind of symbol


def anchors_by_force(text, k=5, s=2):
    """First place of each closed syncmer's hash."""
    def chain(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed=seed)
        return seed

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    symbols = re.findall("[\u4e00-\u9fff]|[^ \t-\r\u4e00-\u9fff]+", text)
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in symbols]
    out = {}
    if h and len(h) < k:
        out[chain(h) & 0x7FFFFFFF] = 0
    g = [chain(h[i : i + s]) for i in range(len(h) - s + 1)]
    for i in range(len(h) - k + 1):
        inner = [signed(x) for x in g[i : i + k - s + 1]]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(chain([g[i], g[i + 2], g[i + 3]]) & 0x7FFFFFFF, i)
    return out


def likeness_by_force(a, b, drift=64):
    if not a and not b:
        return 1.0
    moved = [b[x] - a[x] for x in a if x in b]
    best = max([0, *(max(Counter((m + shift) // drift for m in moved).values(), default=0) for shift in (0, drift // 2))])
    return best / (len(a) + len(b) - len(moved))


def test_fingerprints_and_likeness_by_force(spark, odd):
    rng = random.Random(12)
    base = [prose(rng, 20) for _ in range(30)]
    mixed = rng.sample(base, len(base))
    shared = prose(rng, 60)
    alone = "".join(chr(0x4E00 + rng.randrange(500)) for _ in range(90))
    texts = [" ".join(base), " ".join(mixed), " ".join(base[:15] + [prose(rng, 100)] + base[15:]),
             f"{prose(rng, 9000)} {shared} {prose(rng, 2000)}", f"{prose(rng, 300)} {shared} {prose(rng, 11000)}", alone, "a b " + alone[5:], "one two", ""]
    rows = [(i, t, *(None,) * 3) for i, t in enumerate(texts)]
    some = [(r.doc_id, r.text) for r in odd.where("doc_id >= 5 AND doc_id <> 9").collect()]
    rows = [(1000 + i, t) for i, t, *_ in rows] + [(i, t) for i, t in some]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), syncmers.SyncmerOptions(rows=2)).collect()}
    line = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(line):
        following = line[(k + 1) % len(line)][1]
        half = len(t) // 2
        own, edited, other = (anchors_by_force(x) for x in (t, t[: len(t) - half] + following[:half], following))
        for place, want in ((got[i].fingerprint, own), (got[i].edited_fingerprint, edited)):
            assert place == " ".join(f"{p}:{h:08x}" for h, p in sorted(want.items(), key=lambda x: x[::-1])), i
        assert got[i].near_edited == pytest.approx(likeness_by_force(own, edited), abs=1e-12)
        assert got[i].near_next == pytest.approx(likeness_by_force(own, other), abs=1e-12)
    assert got[1001].near_next < 0.3  # the same passages in another order
    assert got[1002].near_next < 0.3
    assert 0 < got[1004].near_next < 0.05  # 60 words of 11,000, far from each other
    assert got[1006].near_next > 0.8  # a script without spaces
    assert likeness_by_force(anchors_by_force(texts[2]), anchors_by_force(texts[0])) > 0.35  # a passage put in between


def test_fingerprints_stay_in_the_jvm(spark, odd):
    plan = syncmers.fingerprints(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def conversation_by_force(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode()))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        yield conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "[", "<", "\\", "\\\\", " ", "\n", "[ROLE]", "[/TEXT]", "<<SYS>>", "<</SYS>>", "a", "é\U0001f600", "[/ROLE]"]
    roles = ["user", "assistant", "system", "tool", None, "", "[/ROLE]x", "user "]
    rows = [(rng.choice([1, 2, 3, None, -1]), rng.choice([None, 1, 2, 3]), rng.choice(roles), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(9))]))
            for _ in range(120)] + [(9, k, "assistant", "word " * 3000) for k in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    for options in (chat.ChatOptions(), chat.ChatOptions(part_chars=40)):
        got = chat.digests(chat.format_conversations(df, options)).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(conversation_by_force(rows), key=repr)
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


def test_template_language():
    from idcordon.llm import template as t

    def show(source, **values):
        return "".join(x for x in t.compile_template(source)(**values) if isinstance(x, str))

    assert show("{{ 1 + 2 * 3 }}{{ 'a' ~ x | upper }}", x="b") == "7aB"
    assert show("{% for i in xs %}{{ loop.index }}{% if loop.last %}!{% elif i.k == 'a' %}A{% else %}-{% endif %}{% endfor %}", xs=[{"k": "a"}, {"k": "b"}, {}]) == "1A2-3!"
    assert show("a {#- gone -#} b{% set y = x['q'] %}{{ y | default('none') }}", x={}) == "abnone"
    folded = t.fold(t.parse("a{{ 'b' | upper }}{% if 1 < 2 %}c{% endif %}"), t.FILTERS)
    assert folded == (t.Print(t.Const("aBc")),)
    for bad in ("{{ x.__class__ }}", "{% if %}", "{{ 'a' | nothing }}", "{% for x in y %}", "{{ x() }}", "{{ 1 }"):
        with pytest.raises((t.TemplateError, AttributeError)):
            show(bad, x=1)
