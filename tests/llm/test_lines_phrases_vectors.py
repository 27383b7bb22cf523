"""Line dedup, collocations and whitening against plain readings of their rules."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from traitweave.llm import collocations as C
from traitweave.llm import line_dedup as L
from traitweave.llm import queries as Q
from traitweave.llm import whitening as W

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# -- line dedup -----------------------------------------------------------------


def plain_lines(docs, min_chars, min_docs):
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            key = low(line.strip(WHITE))
            if len(key) >= min_chars:
                held[key].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := low(x.strip(WHITE))) not in gone or gone[k] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_like_a_plain_reading(spark):
    rng = np.random.default_rng(3)
    pool = [f"line number {k} É of the pool" for k in range(40)] + ["short", "", "   ", "\tA Line With Tabs and ENDS \r", "a line with tabs and ends"]
    docs = []
    for i in range(1, 121):
        picks = [pool[int(k)] for k in rng.integers(0, len(pool), size=int(rng.integers(0, 90)))]
        docs.append((i, "\n".join([*picks, "the one line that everybody has", f"only in document number {i}"])))
    # More lines than one word of the bitmap; the last lines are dropped, the first 200 stay.
    docs += [(0, "\n".join(f"own line {k} of the long document" for k in range(200)) + "\n" + pool[0] + "\n\n" + pool[1])]
    docs += [(501, None), (502, ""), (503, "\n"), (504, "the one line that everybody has")]
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_chars=20, min_docs=3)
    got = {r.id: (r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()}
    assert got == plain_lines(docs, 20, 3)
    assert got[501] == got[502] == (1, 0, "") and got[503] == (2, 0, "\n") and got[504][1] == 0 and got[0][1] == 2


def test_hot_lines_are_dealt_and_summed(spark, monkeypatch):
    docs = [(i, f"the line of all the documents\nrow {i % 400} of a few of them, twice") for i in range(2_500)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    lines = L._lines(L._documents(table, "doc_id", "text"), 20)
    assert L._hot_keys(lines).count() == 401
    want = plain_lines(docs, 20, 3)
    for share in (1_000, 3):  # a third of the lines makes a key hot, then a thousandth does
        monkeypatch.setattr(L, "HOT_SHARE", share)
        got = {r.id: (r.n_lines, r.n_dropped, r.kept_text) for r in L.dedup_lines(table).collect()}
        assert got == want


def test_a_bitmap_holds_the_words_with_dropped_lines_only(spark):
    long = "\n".join(f"own line {k} of the long document" for k in range(1_000)) + "\nthe one line that everybody has"
    docs = [(1, long), (2, "the one line that everybody has"), (3, "the one line that everybody has")]
    maps = L.line_bitmaps(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    found = {r.d: [tuple(w) for w in r.keep] for r in maps}
    assert found == {1: [(15, ~(1 << 40))], 2: [(0, ~1)]}


# -- collocations ---------------------------------------------------------------


def counted(text, depth):
    """Phrases of up to ``depth`` words of a sequence of ids in which 0 separates."""
    out = Counter()
    for i in range(len(text)):
        for k in range(1, depth + 1):
            words = tuple(int(w) for w in text[i:i + k])
            if len(words) == k and 0 not in words:
                out[words] += 1
    return out


@pytest.mark.parametrize("size,n,depth", [(3, 60, 4), (12, 400, 3), (400, 3000, 3), (2, 30, 5), (1 << 17, 500, 4)])
def test_index_finds_every_phrase(size, n, depth):
    rng = np.random.default_rng(size)
    text = rng.integers(0, size, size=n)
    used = np.unique(text[text > 0])
    to = np.zeros(size, np.int64)
    to[used] = np.arange(1, len(used) + 1)
    text = np.append(to[text], 0)
    if size > 1 << 16:  # ids so wide that the beginnings do not fit one number
        text, used = text * 300, np.arange(300 * len(used) + 1)[1:]
    want, found, shorter = counted(text, depth), {}, None
    for p in C.enumerate_phrases(text, len(used) + 1, depth):
        real = p.count > 0
        words = [tuple(w) for w in p.words.tolist()]
        found |= {w: c for w, c, r in zip(words, p.count.tolist(), real, strict=True) if r}
        if shorter is not None:
            assert [shorter[k] for k in p.first] == [w[:-1] for w in words] and [shorter[k] for k in p.rest] == [w[1:] for w in words]
        shorter = words
    assert found == want


def test_thinning_keeps_every_phrase_whose_parts_are_marked():
    rng = np.random.default_rng(8)
    text = np.append(rng.integers(0, 9, size=500), 0)
    hashes = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    pairs = [w for w, c in counted(text, 2).items() if len(w) == 2 and c >= 8]
    bits = np.zeros(C.MAP_BITS // 8, np.uint8)
    spots = C._spot(hashes[np.array(pairs) - 1], C._lang_hash("en"))
    np.bitwise_or.at(bits, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
    want = {w: c for w, c in counted(text, 3).items() if len(w) == 3 and w[:2] in pairs and w[1:] in pairs}
    thin = C._thinned(text, hashes, "en", bits, 3)
    assert {w: c for w, c in counted(thin, 3).items() if len(w) == 3} == want and len(thin) < len(text)


def test_long_texts_are_cut_at_the_ends_of_pieces():
    text = b"one two three, four five; " * 50 + b"x" * 300 + b" tail. end"
    parts = list(C._split(text, 100))
    assert b"".join(parts) == text and all(p[-1:] in b".,;:!?" or len(p) <= 100 or p is parts[-1] or p[-2:] == b"; " for p in parts)
    assert all(p.rstrip()[-1:] in b".,;" for p in parts[:-1])
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"], "text": ["x y. z", "", "w"]})
    assert [(k, v.to_pylist()) for k, v in C._shards(iter([batch]))] == [("a", [b"x y. z", b"w"]), ("b", [b""])]


def plain_collocations(docs, max_words, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    found = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    for (lang, p), a in found.items():
        if any(lang == g and len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, first, rest = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), first, rest))
    return {(lang, i + 1, p.decode(), -a, first, rest, n[lang], -score)
            for lang, rows in out.items() for i, (score, a, p, first, rest) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_collocations_like_a_plain_reading(spark, max_words):
    rng = np.random.default_rng(4)
    words = ["the", "New", "york", "City", "of", "ça", "x-y", "漢字", "a b", "zeta"]
    docs = []
    for i in range(150):
        picks = [words[int(k)] for k in rng.zipf(1.6, size=60) % len(words)]
        text = "".join(w + str(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r", " ; "])) for w in picks)
        docs.append((["en", "fr", None, ""][i % 4], text + " new york city" * (i % 3)))
    docs += [("en", None), ("de", ""), ("de", ".,;"), (None, "   ")]
    got = C.collocations(spark.createDataFrame(docs, "lang string, text string"), max_words=max_words, min_count=5, top=12)
    assert {tuple(r) for r in got.collect()} == plain_collocations(docs, max_words, 5, 12)


def test_scores_beyond_64_bits(spark):
    """``1000000 a a`` of four thousand million occurrences is exact, through the same expression as in the operator."""
    row = spark.sql("select cast(4000000001 as decimal(16,0)) a, cast(5000000007 as decimal(16,0)) l, cast(9000000011 as decimal(16,0)) r")
    got = row.selectExpr("(a * a * cast(1000000 as decimal(7,0))) div (l * r)").first()[0]
    assert got == 1_000_000 * 4_000_000_001**2 // (5_000_000_007 * 9_000_000_011)


# -- whitening ------------------------------------------------------------------


def plain_whitening(vectors, k):
    x = np.floor(64 * np.unique(np.array(vectors, float), axis=0)) + 1_000_000
    x = np.unique(x, axis=0)
    n, mean = len(x), x.mean(axis=0)
    cov = (x - mean).T @ (x - mean) / n
    e, v = np.linalg.eigh(cov)
    return n, [int(s) for s in x.sum(axis=0)], mean, e[::-1][:k], v[:, ::-1][:, :k], np.trace(cov)


def test_whitening_like_a_plain_reading(spark):
    got = Q.op13_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, sums, mean, e, v, trace = plain_whitening([r.embedding for r in table], 16)
    rows = defaultdict(dict)
    for r in got:
        rows[r.vec_id][r.component] = r
    assert set(rows) == {r.vec_id for r in table} and all(sorted(c) == list(range(1, 17)) for c in rows.values())
    ids = [r.vec_id for r in table]
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding] for r in table]
    want = (np.array(x) - mean) @ v / np.sqrt(e)
    found = np.array([[rows[i][k].whitened for k in range(1, 17)] for i in ids])
    assert np.allclose(np.abs((found * want).sum(axis=0)), (want * want).sum(axis=0), rtol=1e-9)
    sign = np.sign((found * want).sum(axis=0))
    assert np.allclose(found * sign, want, atol=1e-7)
    for i, row in zip(ids, x, strict=True):
        r = rows[i][1]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        assert r.identity_error < 1e-9
        assert all(abs(rows[i][k + 1].explained * trace / e[k] - 1) < 1e-9 for k in range(16))


def test_vectors_that_are_left_out_and_equal_ones(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    same = [(100 + i, good[0][1]) for i in range(5)] + [(None, good[1][1]), (7, good[7][1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, nan, 2.0]), (204, [inf, 0.0, 0.0]), (205, [1e300, 0.0, 0.0])]
    short = [(300 + i, [float(c) for c in rng.normal(size=2)]) for i in range(9)]
    alone = [(400, [1.0]), (401, [1.0])]
    table = spark.createDataFrame(good + same + bad + short + alone, "vec_id bigint, embedding array<double>")
    got = W.whiten_embeddings(table).collect()
    assert sorted(r.id or -1 for r in got) == sorted((i or -1) for i, _ in good + same + short + alone)
    by = {r.id: r for r in got}
    assert {by[i].n for i in range(40)} == {40} and {by[300 + i].n for i in range(9)} == {9} and by[400].n == 1
    assert by[100].whitened == by[0].whitened and len(by[0].whitened) == 3 and len(by[300].whitened) == 2 and by[400].whitened == []
    assert sum(by[0].explained) == pytest.approx(1)
    weighted = {r.id: r for r in W.whiten_embeddings(table, weighted=True).collect()}
    assert weighted[0].n == 47
    x = np.floor(64 * np.array([v for _, v in good + same])) + 1_000_000
    assert np.sum(weighted[3].explained[0]) == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True))[-1] / np.trace(np.cov(x.T, bias=True)))


def test_deviation_is_exact_beyond_64_bits(spark):
    rows = [(i, [float(2.0**40 * (i - 3)), float(i)]) for i in range(9)]
    got = {r.id: int(r.deviation) for r in W.whiten_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((9 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert max(got.values()) > 2**63
