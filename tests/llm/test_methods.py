"""Results that come through the method: without it they are not there."""

import numpy as np

from traitweave.llm import exact_dedup, language_id


def test_kept_rows_are_read_from_the_index(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), f"text {rng.integers(0, 60)}") for i in rng.permutation(300)] + [(None, "text 1"), (7, "only here"), (7, "only here")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [sorted(map(tuple, exact_dedup.exact_dedup(table, batches=n).collect()), key=repr) for n in (1, 2, 5)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(t, []).append(i)
    for i, digest, keep, size, kept in found[0]:
        group = next(g for t, g in texts.items() if exact_dedup_digest(t) == digest)
        assert size == len(group) and keep == (None if None in group else min(group)) and kept == (i == keep)
    seen = []
    ingest = exact_dedup.DigestIndex.ingest
    monkeypatch.setattr(exact_dedup.DigestIndex, "ingest", lambda self, part: seen.append(part.count()) or ingest(self, part))
    exact_dedup.exact_dedup(table)
    assert len(seen) == 2 and sum(seen) == len(rows) and min(seen) > 50
    monkeypatch.setattr(exact_dedup.DigestIndex, "ingest", lambda self, part: 1)
    assert exact_dedup.exact_dedup(table).count() == 0


def exact_dedup_digest(text):
    import hashlib

    return hashlib.sha256(" ".join(text.split()).encode()).hexdigest()


def test_an_index_leaves_no_name_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_the_language_model_is_that_of_the_sample(spark):
    """The task that fits gives the model that numpy gives on the same rows."""
    words = {"aa": ["alba", "rosa", "luna"], "bb": ["strumpf", "kraft", "zwerg"]}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k], 12)), k) for i in range(60) for k in ("aa", "bb")] * 2 + [(900, None, "aa"), (901, "luna", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train_language_id(table, max_rows=40)
    again = language_id.train_language_id(table.repartition(7), max_rows=40)
    assert model.labels == ["aa", "bb"] and np.array_equal(model.matrix, again.matrix) and model.accept_from == again.accept_from
    got = table.where("text is not null and lang is not null").select("lang", language_id.predict_language(table["text"], model).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang for r in got]) > 0.95
    assert language_id.train_language_id(table.where("lang is null")).labels == []
