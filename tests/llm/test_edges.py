"""Every query on awkward tables: NULLs in any column, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import pytest

from traitweave.llm import queries as Q

CLASH = "id,uid,size,key,n,row,shard,slot,kept,keep_id,digest,place,text_,copy,words,leaks,_uid,_src,_order,component,target,draws,p,_n,_text,_all,_names,_longest,uid_,at,label,c,item,items".split(",")
LONG = "wort " * 30_000 + "ende"
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "de", "b"), (5, "12 34 !!", "de", "b"),
    (6, LONG, "de", "b"), (6, LONG, "de", "b"), (7, LONG, "de", "c"), (None, "no id here", "en", None),
    (None, None, None, None), (8, "x" * 50_000, "en", "a"), (9, "a " * 40, "en", "a"), (10, "漢字 𐍈 é\u0000 ü", "fr", "c"),
    (11, "one two three four five six seven eight nine ten eleven twelve", "en", "d"),
]
PAGES = [(1, "http://h.example/a", "<p>a</p>"), (2, None, None), (None, "", ""), (1, "http://h.example/a", "<p>a</p>"), (3, "x", "<p>" * 3000 + "deep &amp; <b")]


def write(spark, path, docs, pages):
    extra = ", ".join(f"'x' AS `{c}`" for c in CLASH)
    doc_schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(*d, len(d[1] or "")) for d in docs]
    spark.createDataFrame(rows, doc_schema).selectExpr("*", *[e.strip() for e in extra.split(", ")]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text").write.parquet(f"{path}/pages.parquet")
    items = [(0, docs[0][1]) if docs else (0, "some words"), (1, None), (2, ""), (None, "no id here")]
    vectors = [(1, [0.5, -1.0]), (2, None), (None, [0.25, 3.0]), (3, []), (3, [1.0, None]), (4, [float("nan"), 0.0]), (1, [0.5, -1.0])] if docs else []
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").selectExpr(
        "*", "1 AS n", "2 AS size", "3 AS x", "4 AS id", "5 AS whitened").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS n").write.parquet(f"{path}/benchmark.parquet")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    write(spark, path, TEXTS, PAGES)
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    write(spark, path, [], [])
    return path


NAMES = [n for n in Q.QUERIES if n != "pipeline"]


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op11_collocations", "op13_whitening")])
def test_one_row_for_each_row(spark, awkward, name):
    got = Q.QUERIES[name](spark, awkward).collect()
    want = [p[0] for p in PAGES] if name == "op3_html" else [d[0] for d in TEXTS]
    assert sorted((r[0] is not None, r[0] or 0) for r in got) == sorted((w is not None, w or 0) for w in want)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    assert {"_uid", "leaks", "shard", "slot", "_n", "_text"} <= set(docs.columns)
    Q.pipeline(spark, awkward).write.parquet(path := str(tmp_path / "out"))
    got = spark.read.parquet(path)
    assert got.columns == [*docs.columns, "_shard", "_slot"]
    assert got.schema[:len(docs.columns)] == docs.schema[:]
    assert all(r[c] == "x" for r in got.collect() for c in CLASH) and got.where("_shard between 0 and 15").count() == got.count()
    kept = {r.doc_id for r in got.collect()}
    # 1 is in the benchmark, and so is its copy; texts without letters go; of equal texts the first stays.
    assert 1 not in kept and 11 not in kept and not kept & {2, 3, 4, 5, 7}
    assert Q.pipeline(spark, empty).count() == 0


def test_each_stage_returns_the_columns_it_got(spark, awkward, empty, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, awkward)
        out.write.parquet(path := str(tmp_path / name))
        got = spark.read.parquet(path)
        assert got.columns == docs.columns and all(r[c] == "x" for r in got.collect() for c in CLASH)
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0
    ids = {name: sorted((r.doc_id or -1) for r in spark.read.parquet(str(tmp_path / name)).collect()) for name, _ in P.STAGES[:-1]}
    assert not set(ids["language_id"]) & {2, 3, 4, 5}
    # 6 is there twice and 7 is its copy, 11 is a copy of 1; texts without words are copies of nothing.
    assert ids["near_dedup"] == sorted([1, 2, 3, 4, 5, 6, -1, -1, 8, 9, 10])
    # An item without an id has no window, so the row "no id here" stays.
    assert not set(ids["decontamination"]) & {1, 11} and len(ids["decontamination"]) == len(TEXTS) - 2


def test_phrases_and_vectors_of_awkward_tables(spark, awkward):
    # The long text has one word only: "wort wort" is inside "wort wort wort".
    found = {(r.lang, r.phrase): r for r in Q.op11_collocations(spark, awkward).collect()}
    assert found["de", "wort wort wort"].a == 3 * 29_998 and found["en", "a a a"].a == 38 and ("en", "a a") not in found
    vectors = Q.op13_whitening(spark, awkward).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in vectors) == [(0, 1, 2), (1, 1, 2), (1, 1, 2)]


def test_defined_values(spark, awkward):
    lines = {r.doc_id: r for r in Q.op12_line_dedup(spark, awkward).collect()}
    assert lines[2].n_lines == lines[3].n_lines == 1 and lines[4].n_lines == 2 and lines[6].n_dropped == lines[7].n_dropped == 0
    tokens = {r.doc_id: r for r in Q.op4_tokens(spark, awkward).collect()}
    assert tokens[2].n_tokens == tokens[3].n_tokens == tokens[2].n_bytes == 0 and not tokens[2].over_limit
    dedup = {r.doc_id: r for r in Q.op5_exact_dedup(spark, awkward).collect()}
    # NULL, empty and white space only: the first two are equal, the third is one space. The row without an id stays.
    assert dedup[2].keep_id is None and dedup[2].group_size == 3 and not dedup[2].kept
    assert dedup[6].keep_id == dedup[7].keep_id == 6 and dedup[6].group_size == 3
    near = {r.doc_id: r for r in Q.op6_near_dedup(spark, awkward).collect()}
    assert near[2].component_id == 2 and near[2].n_shingles == 0
    assert near[7].component_id == 6 and near[11].component_id == 1
    passages = {r.doc_id: r for r in Q.op8_substring_dedup(spark, awkward).collect()}
    assert passages[9].n_words == 40 and passages[9].n_removed == 39
    assert passages[7].n_removed == passages[7].n_words == 30_001
    lang = {r.doc_id: r for r in Q.op10_language_id(spark, awkward).collect()}
    assert lang[2].lang_pred == lang[5].lang_pred == "und" and lang[2].score == 0
    mix = {r.doc_id: r for r in Q.op2_mixing(spark, awkward).collect()}
    assert mix[2].taken == 0 and all(r.taken <= 3 * r.size for r in mix.values())
    leaks = {r.doc_id: r for r in Q.op7_decontamination(spark, awkward).collect()}
    assert leaks[1].n_hit == 12 and leaks[11].contaminated and not leaks[6].contaminated
