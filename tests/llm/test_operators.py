"""The operators against brute force on small inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traitweave.llm import common, decontaminate, exact_dedup, html_extract, language_id, mixing, near_dedup, sharding, substring_dedup

WHITE = " \t\n\x0b\x0c\r"


def split(text):
    return "".join(" " if c in WHITE else c for c in text or "").split(" ") if text else []


def words(text):
    return [w for w in split(text) if w]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# -- words ------------------------------------------------------------------


def test_words_of_arrow_slices():
    texts = ["a bb", "", None, "  ", "c", "d\x0be f", "x" * 10]
    inside, to = common.byte_table(common.WHITE, lower=True)
    got = []
    for _, data, offsets in common.text_slices(pa.array(texts, pa.string()).slice(0)):
        starts, ends, bounds = common.find_words(data, offsets, inside)
        for r in range(len(offsets) - 1):
            got.append([data[s:e].tobytes().decode() for s, e in zip(starts[bounds[r]:bounds[r + 1]], ends[bounds[r]:bounds[r + 1]])])
        same = common.hash_words(data, starts, ends, to)
        assert len(set(same.tolist())) == len({w for row in got for w in row})
    assert got == [words(t) for t in texts]


# -- sharding -----------------------------------------------------------------


def minimax(sizes, shards):
    def need(c):
        n, load = 1, 0
        for s in sizes:
            if s > c:
                return shards + 1
            n, load = (n, load + s) if load + s <= c else (n + 1, s)
        return n

    c = max(max(sizes), -(-sum(sizes) // shards))
    while need(c) > shards:
        c += 1
    return c


@pytest.mark.parametrize(("n", "shards", "digits"), [(40, 4, 1), (300, 7, 1), (3, 8, 3), (200, 16, 2)])
def test_minimax_cuts(spark, monkeypatch, n, shards, digits):
    monkeypatch.setattr(sharding, "DIGITS", digits)
    rng = random.Random(n)
    groups = sorted((hashlib.md5(str(i).encode()).hexdigest(), rng.choice([1, 5, 50, 1000])) for i in range(n))
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "key string, bytes bigint"), shards)
    sizes = [s for _, s in groups]
    assert capacity == minimax(sizes, shards)
    want, load = [], 0
    for key, size in groups:
        if load + size > capacity:
            want.append(key)
            load = 0
        load += size
    assert cuts == want


def test_shards_keep_groups_and_slots_are_gapless(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 50} " * (i % 7)) for i in range(600)]
    got = sharding.shard_documents(frame(spark, rows), 4).collect()
    assert len(got) == 600
    place = defaultdict(set)
    by = defaultdict(list)
    text = dict(rows)
    for r in got:
        place[text[r.id]].add(r.shard)
        by[r.shard].append(r.slot)
        assert r.size == len(text[r.id]) + 1 and r.text_crc32 == zlib.crc32(text[r.id].encode())
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(4))


def test_large_group_has_a_shard_of_its_own(spark):
    rows = [(i, "x" * 900 if i < 50 else f"text {i} " + "y" * 90) for i in range(300)]
    sizes = Counter()
    for r in sharding.shard_documents(frame(spark, rows), 5).collect():
        sizes[r.shard] += r.size
    assert sizes[0] == 50 * 901
    rest = [sizes[i] for i in range(1, 5)]
    assert max(rest) - min(rest) <= 3 * 110


# -- mixing -------------------------------------------------------------------


def water_fill(sizes, weights, times):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / share > times * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / share
            break
        for i in over:
            target[i] = times * sizes[i]
            open_.discard(i)
        left = total - sum(times * sizes[i] for i in set(range(len(sizes))) - open_)
    return target


def test_mixture_meets_its_targets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        s = rng.choices(["a", "b", "c", "é", None], [60, 20, 10, 9, 1])[0]
        rows.append((i, "w " * rng.choice([0, 1, 5, 30, 200]), s))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    drawn = mixing.draw_mix(docs, (1, 2, 3), shards=5)
    got = drawn.collect()
    assert len(got) == 900
    size, taken, target = Counter(), Counter(), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.id]
        size[s] += r.size
        taken[s] += sum(d.words for d in r.draws)
        target[s] = r.target
        assert sum(d.words for d in r.draws) <= 3 * r.size
        assert all(0 <= d.shard < 5 for d in r.draws)
    names = ["a", "b", "c", "é", None]
    want = water_fill([size[s] for s in names], [1, 2, 3, 1, 2], 3)
    for s, t in zip(names, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1
    again = mixing.draw_mix(docs.repartition(7), (1, 2, 3), shards=5).collect()
    key = lambda r: r.id
    assert sorted(got, key=key) == sorted(again, key=key)
    # Shards are near even, and each block of a source is in one shard.
    load, home = Counter(), defaultdict(set)
    for r in got:
        for d in r.draws:
            load[d.shard] += d.words
            home[source[r.id], d.block].add(d.shard)
    assert all(len(v) == 1 for v in home.values())
    assert max(load.values()) < 1.6 * min(load.values())


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_splitting_tree_keeps_quotas(spark, shards):
    quotas = spark.createDataFrame([(0, 100), (1, 0), (2, 37), (3, 263)], "place int, quota bigint")
    got = mixing.splitting_tree(quotas, shards, 1).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.place] += r.blocks
        by_shard[r.shard] += r.blocks
    assert [by_source[i] for i in range(4)] == [100, 0, 37, 263]
    assert len(by_shard) == shards and max(by_shard.values()) - min(by_shard.values()) <= 2 + (shards > 4)


def test_splits_are_hypergeometric(spark):
    quotas = spark.createDataFrame([(0, 60), (1, 40)], "place int, quota bigint")
    left = [next(r.blocks for r in mixing.splitting_tree(quotas, 2, seed).collect() if r.shard == 0 and r.place == 0) for seed in range(60)]
    # 50 of 100 places, 60 marked: mean 30, variance 50 * .6 * .4 * 50 / 99 = 6.06.
    assert abs(np.mean(left) - 30) < 1.2 and 3 < np.var(left) < 11


def test_mix_is_written_in_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(40)], "doc_id bigint, text string, source string")
    drawn = mixing.draw_mix(docs, (1,), shards=4, keep=True)
    mixing.write_mix(mixing.mixed_rows(drawn, whole=True), str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.count() == 40 and back.select("shard").distinct().count() == 4
    assert back.select("row.text").distinct().count() == 1


# -- exact dedup ----------------------------------------------------------------


def test_index_over_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = exact_dedup.exact_dedup(frame(spark, [(3, "a  b"), (2, "a\tb"), (5, "c")]), index=index).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in first} == {(3, 2, 2, False), (2, 2, 2, True), (5, 5, 1, True)}
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    second = exact_dedup.exact_dedup(frame(spark, [(1, "a b"), (7, "d"), (6, "d"), (8, None)]), index=again).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in second} == {(1, 2, 1, False), (7, 6, 2, False), (6, 6, 2, True), (8, 8, 1, True)}
    assert again.rows().count() == 4
    plan = again.rows().select("digest").hint("merge").join(frame(spark, []).select(F.unhex(F.lit("00")).alias("digest")).hint("merge"), "digest", "left_semi")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(digest") <= 1


# -- near dedup -------------------------------------------------------------------


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 30, 120]))
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rows += [(10_000, ""), (10_001, None), (10_002, "One TWO"), (10_003, "one two"), (10_004, "two one")]
    rng.shuffle(rows)
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            s, r = sets[ids[a]], sets[ids[b]]
            if s and r and 100 * len(s & r) >= 80 * len(s | r):
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    got = near_dedup.near_duplicates(frame(spark, rows), width=4).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.n_shingles, r.component) for r in got} == {i: (len(s), root(i)) for i, s in sets.items()}


def test_sketches_tell_similar_from_unlike():
    rng = np.random.default_rng(0)
    limit = near_dedup.sketch_limit(80)
    assert 60 < limit < 110
    rng.integers(0, 9)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(-5, -9)]
    got = dict(map(tuple, common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert all(got[i] == 1 for i in range(2, 61)) and all(got[i] == 100 for i in range(101, 140)) and got[-5] == -9
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- decontamination ---------------------------------------------------------------


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)  # several passes
    rng = random.Random(5)
    vocabulary = ["a", "B", "cé", "d1", "漢", "zz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 14, 30])))) for i in range(14)] + [(99, "?!"), (100, None)]
    docs = []
    for i in range(60):
        text = rng.choices(vocabulary + ["other"], k=rng.randrange(40))
        if i % 3 == 0:
            item = decontaminate.words_of(rng.choice(items[:14])[1])
            text[len(text) // 2:len(text) // 2] = item[:rng.choice([9, 10, 12, 30])]
        docs.append((i, ", ".join(text)))
    docs += [(60, None), (61, "")]
    got = decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: r for r in got.select("doc_id", "leaks.*", decontaminate.hit_words(F.col("leaks.ranges")).alias("hit")).collect()}
    for i, text in docs:
        w = decontaminate.words_of(text)
        hit, names = set(), set()
        for item, t in items:
            v = decontaminate.words_of(t)
            n = min(10, len(v))
            for k in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[k:k + n]:
                        hit.update(range(p, p + n))
                        names.add(str(item))
        assert (got[i].n_words, got[i].hit, got[i]["items"]) == (len(w), len(hit), sorted(names))


def test_longest_match(spark):
    docs = frame(spark, [(1, "x y q w e r t z"), (2, "nothing")])
    got = decontaminate.find_leaks(docs, spark.createDataFrame([(1, "q w e r t a b c d e f g")], "item_id bigint, text string"), window=4)
    assert {r.doc_id: r.leaks.longest for r in got.collect()} == {1: 5, 2: 0}


# -- passages -----------------------------------------------------------------------


def passages(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_passages_against_brute_force(spark, window):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [rng.choices(vocabulary, k=k) for k in (19, 20, 21, 45, 130)]
    rows = []
    for i in range(120):
        text = rng.choices(vocabulary, k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(shared)
        if i % 10 == 0:
            text += ["the"] * rng.randrange(60)
        if i % 10 == 1:
            text += ["ab", "cd", "ef"] * rng.randrange(30)
        rows.append((1000 - 3 * i, " ".join(text)))
    rows += [(2000 + i, rows[i % 7][1]) for i in range(30)] + [(5000, None), (5001, ""), (5002, "W1 w1")]
    rng.shuffle(rows)
    got = substring_dedup.repeated_passages(frame(spark, rows), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == passages(rows, window)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    for trial in range(600):
        # Few words make runs that cross the window's ends.
        most = (2, 4, 40)[trial % 3]
        window = rng.integers(0, most, 20).astype(np.uint64)
        a = np.concatenate([rng.integers(0, most, rng.integers(0, 30)), window, rng.integers(0, most, rng.integers(0, 30))]).astype(np.uint64)
        b = np.concatenate([rng.integers(0, most, rng.integers(0, 30)), window, rng.integers(0, most, rng.integers(0, 30))]).astype(np.uint64)
        keys = []
        for text in (a, b):
            name, place = substring_dedup.anchors(common.mix(text + np.uint64(1)), np.array([0, len(text)]))
            at = next(i for i in range(len(text) - 19) if (text[i:i + 20] == window).all())
            keys.append((name[at], place[at] - at))
        assert keys[0] == keys[1]


# -- HTML ---------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">Cookies!</div><div class="ad">Buy</div>
<article><h1>Head &lt;%d&gt;</h1><p><b>Bold<br>line &eacute;&#8212;x<p>Two   <i>words</i>,
and more<div class="share">Share</div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><!-- <p>gone</p> --><form><p>Mail</p></form>
<section id="comments"><p>Great!</p></section></article><aside>Side</aside><footer>&copy; x</footer>"""
WANT = "Head <{}>\nBold line é—x\nTwo words, and more\none\ntwo\nc1\nc2"


def test_main_text_of_a_page(spark):
    rows = [(i, "http://one.example/%d" % i, PAGE % i) for i in range(3)] + [(9, None, None)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "" and [got[i] for i in range(3)] == [WANT.format(i) for i in range(3)]


def test_wrapper_finds_unmarked_template(spark):
    page = "<html><body><div class=top>My site</div><div class=body><p>text %d</p><p>more %d</p></div><div class=legal>All rights</div></body></html>"
    rows = [(i, f"https://u@h{i % 2}.example:80/{i}", page % (i, i * 7)) for i in range(40)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"text {i}\nmore {i * 7}" for i in range(40)}
    # Copies alone say nothing about a template.
    rows = [(i, "http://c.example/", page % (1, 1)) for i in range(20)]
    got = {r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {"My site\ntext 1\nmore 1\nAll rights"}


def test_tree_matching_keeps_order():
    a, b = (html_extract.skeleton(html_extract.Page(h).root) for h in (
        "<div><p>x</p><ul><li>1</ul><h2>t</h2></div>", "<div><h3>n</h3><p>x</p><h2>u</h2><p>z</p></div>"))
    votes = {}
    html_extract.match(a, b, "", votes)
    assert votes == {"div/p": [1, 0], "div/h2": [0, 1]}


def test_hostile_markup_is_linear():
    for html in ("<a " * 200_000, "<" * 500_000, "<p>" * 100_000, '<a href="' * 50_000, "<!--" * 200_000, "<script>" * 50_000, "&" * 300_000):
        html_extract.Page(html)


# -- language -------------------------------------------------------------------------


def test_languages_are_told_apart(spark):
    rng = random.Random(0)
    parts = {"aa": ["tion", "the", "ing"], "bb": ["ção", "ões", "lh"], "cc": ["schl", "ung", "ß"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text, lang if i % 9 else None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train_language_id(docs.where("doc_id < 200"), max_rows=100)
    assert sorted(model.labels) == ["aa", "bb", "cc"] and 0 <= model.accept_from < 0.6
    again = language_id.train_language_id(docs.where("doc_id < 200").repartition(5), max_rows=100)
    assert np.array_equal(model.matrix, again.matrix)
    got = docs.where("doc_id >= 200 and lang is not null").select("lang", language_id.predict_language(F.col("text"), model).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang for r in got]) > 0.98 and all(0 <= r.p.score <= 1 for r in got)
    assert np.mean([r.p.accepted for r in got]) > 0.97
    odd = spark.createDataFrame([(None,), ("",), ("12 -- ²",), ("x",)], "text string").select(language_id.predict_language(F.col("text"), model).alias("p")).collect()
    assert [r.p.lang for r in odd[:3]] == ["und"] * 3 and odd[3].p.lang in parts and not odd[0].p.accepted


def test_no_label_no_language(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    model = language_id.train_language_id(docs)
    got = docs.select(language_id.predict_language(F.col("text"), model).alias("p")).first().p
    assert (got.lang, got.score, got.accepted) == ("und", 0.0, True)
