import pytest

from traitweave.functions import columns as C
from traitweave.operators import aggregating as A
from traitweave.operators import joining as J
from traitweave.operators import prep as M
from traitweave.operators import reshape as P


def test_terms_to_indicators(spark, rows):
    terms = spark.createDataFrame([("t1", "g1 g2"), ("t2", "g2"), ("t3", "g1 g2 g3")], "term STRING, genes STRING")
    long = A.indicator(P.explode_list(terms, "genes"), "genes", "term")
    assert len(rows(long)) == 6
    kept = A.drop_singletons(long)
    assert {r[1] for r in rows(kept)} == {"t1", "t3"}


def test_clean_ids(spark, rows):
    df = spark.createDataFrame([("at|101|x, at|102|y",), (None,)], "c STRING")
    assert rows(P.clean_ids(df, ["c"])) == [("101 102",), (None,)]
    with pytest.raises(Exception):
        P.clean_ids(spark.createDataFrame([("no field",)], "c STRING"), ["c"]).collect()


def test_regulation_flags(spark, rows):
    data = [(0.01, 2.0), (0.01, -2.0), (0.2, 2.0), (None, 2.0), (0.05, 1.0), (0.01, 0.0)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i INT, qval DOUBLE, b DOUBLE")
    assert [r[1:] for r in rows(P.regulation_flags(df), "i", "up", "down")] == [(1, 0), (0, 1)] + [(0, 0)] * 4


def test_complement_name(spark, rows):
    df = spark.createDataFrame([("dge_X_up",), ("dge_X_down",)], "n STRING")
    assert rows(df.select(C.complement_name("n").alias("n"))) == [("dge_X_down",), ("dge_X_up",)]
    with pytest.raises(Exception):
        spark.createDataFrame([("dge_X",)], "n STRING").select(C.complement_name("n")).collect()


def test_transcripts(spark, rows):
    df = spark.createDataFrame([("AT1.1", 1), ("AT2.1", 5)], "t STRING, v INT")
    assert rows(P.transcript_to_gene(df, "t")) == [("AT1", 1), ("AT2", 5)]
    twice = spark.createDataFrame([("AT1.1", 1), ("AT1.2", 5)], "t STRING, v INT")
    assert rows(P.transcript_to_gene(twice, "t", "max")) == [("AT1", 5)]
    with pytest.raises(Exception):
        P.transcript_to_gene(twice, "t").collect()


def test_layout_and_paths(spark, rows):
    files = [("r1", "r1.fastq.gz"), ("r2", "r2_1.fastq.gz"), ("r2", "r2_2.fastq.gz")]
    files += [("r3", f"r3{s}.fastq.gz") for s in ("", "_1", "_2")] + [("r4", "r4_1.fastq.gz"), ("r5", None)]
    df = spark.createDataFrame([(r, f, 0 if r == "r5" else 7) for r, f in files], "run STRING, file STRING, n_processed BIGINT")
    assert rows(A.fastq_layout(df), "run", "layout", "zero_reads") == [
        ("r1", "single", False), ("r2", "paired", False), ("r3", "three_files", False), ("r4", "fail", False), ("r5", "fail", True),
    ]
    runs = spark.createDataFrame([(r,) for r in ("ERR123456", "SRR1234567", "XYZ123456", "ERR12345678")], "run STRING")
    got = {r[0]: r[1:] for r in rows(P.accession_path(runs, "run"))}
    assert got["ERR123456"] == ("ERR123/ERR123456/", "ok")
    assert got["SRR1234567"] == ("SRR123/007/SRR1234567/", "ok")
    assert got["XYZ123456"] == (None, "database unrecognised")
    assert got["ERR12345678"] == (None, "length unrecognised")


def _labels(spark):
    spec = {
        "E1": ["control_1", "control_1", "test_1", "test_1"],
        "E2": ["control_1", "test_1", "control_2", "test_2"],
        "E3": ["control_1", "test_1a", "test_1b"],
        "E4": ["control_1", "test_1a", "test_10a"],
    }
    data = [(f"{e}r{i}", e, c) for e, cs in spec.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(data, "Run STRING, Experiment STRING, Control_test_label STRING")


def test_subexperiments(spark, rows):
    got = J.expand_subexperiments(_labels(spark))
    sizes = {r["sheet"]: r["count"] for r in got.groupBy("sheet").count().collect()}
    assert sizes == {"E1": 4, "E2_1": 2, "E2_2": 2, "E3_1a": 2, "E3_1b": 2, "E4_1a": 2}
    assert rows(got.where("sheet = 'E1'"), "row", "condition") == [
        (1, "control_1"), (2, "control_1"), (3, "test_1"), (4, "test_1")]
    loose = J.expand_subexperiments(_labels(spark), substring_match=True)
    assert {r[0] for r in loose.where("sheet like 'E4%'").select("sheet").distinct().collect()} == {"E4_1a", "E4_10a"}


def test_annotation_counts(spark, rows):
    hits = [("p1", "Pfam", "A"), ("p1", "Pfam", "A"), ("p1", "Pfam", "B"), ("p1", "TMHMM", "T"), ("p2", "MobiDBLite", "m"), ("p3", "Gene3D", "g")]
    df = spark.createDataFrame(hits, "protein STRING, analysis STRING, signature STRING")
    assert rows(A.annotation_counts(df)) == [("p1", 3, 2, None, 1), ("p2", None, None, 1, None)]


def test_impute_and_scale(spark, rows):
    cells = [(i, "x", v) for i, v in enumerate([1.0, None, 3.0, 10.0])] + [(i, "c", 5.0) for i in range(4)]
    long = spark.createDataFrame(cells, "key INT, feature STRING, value DOUBLE")
    filled = M.apply_median(long, M.fit_median(long))
    scaled = M.apply_scaler(filled, M.fit_scaler(filled))
    assert rows(scaled.where("feature = 'x'"), "key", "value") == [(0, -0.950654), (1, -0.365636), (2, -0.365636), (3, 1.681927)]
    assert {r[0] for r in scaled.where("feature = 'c'").select("value").collect()} == {0.0}


def test_wide_preprocessor_agrees(spark, rows):
    df = spark.createDataFrame([(0, 1.0, 1, None), (1, None, None, 2.0), (2, 3.0, 0, 2.0), (3, 10.0, 1, 2.0)], "key INT, x DOUBLE, k INT, c DOUBLE")
    out = M.preprocessor(["x", "c"], ["k"]).fit(df).transform(df)
    assert rows(out, "key", "prep_x", "prep_c", "prep_k") == [
        (0, -0.950654, 0.0, 1.0), (1, -0.365636, 0.0, 0.0), (2, -0.365636, 0.0, 0.0), (3, 1.681927, 0.0, 1.0)]


def test_vectors_keep_empty_rows(spark):
    long = spark.createDataFrame([("a", "f1", 2.0), ("a", "f3", 0.0), ("b", "f3", 1.0)], "key STRING, feature STRING, value DOUBLE")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key STRING")
    got = {r["key"]: r["features"].toArray().tolist() for r in M.to_vectors(long, ["f1", "f2", "f3"], keys).collect()}
    assert got == {"a": [2.0, 0.0, 0.0], "b": [0.0, 0.0, 1.0], "c": [0.0, 0.0, 0.0]}


def test_align_outer(spark, rows):
    a = spark.createDataFrame([("g1", 1), ("g2", 2)], "g STRING, a INT")
    b = spark.createDataFrame([("g2", 3), ("g3", 4)], "g STRING, b INT")
    assert rows(J.align_outer([a, b], "g")) == [("g1", 1, None), ("g2", 2, 3), ("g3", None, 4)]


def test_encode_and_attach(spark, rows):
    df = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "p")], "k STRING, l STRING")
    assert rows(P.encode_minority(df, "l"), "k", "y") == [("a", 0), ("b", 0), ("c", 1)]
    target = spark.createDataFrame([("b", 1)], "k STRING, y INT")
    assert rows(J.attach_target(df.select("k"), target, "y", "k")) == [("a", 0), ("b", 1), ("c", 0)]


def test_integrity_report(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 0)], "k STRING, v INT")
    got = A.integrity_report(df, unique=["k"], not_null=["k"], allowed={"v": [0, 1]}, positive=["v"])
    assert rows(got) == [("allowed v", 1, False), ("not null k", 1, False), ("positive v", 1, False), ("unique k", 1, False)]


def test_align_outer_refuses_what_it_cannot_keep(spark):
    a = spark.createDataFrame([("g1", 5)], "g STRING, v INT")
    with pytest.raises(ValueError, match="several"):
        J.align_outer([a, a], "g")
    twice = spark.createDataFrame([("g1", 1), ("g1", 2)], "g STRING, x INT")
    with pytest.raises(Exception, match="g1"):
        J.align_outer([a, twice], "g").collect()


def test_vectors_refuse_missing_cells(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "b", None)], "key INT, feature STRING, value DOUBLE")
    with pytest.raises(Exception, match="impute"):
        M.to_vectors(long, ["a", "b"])


def test_preprocessor_with_odd_names(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, None)], "`a.b` DOUBLE, `c``d` INT")
    out = M.preprocessor(["a.b"], ["c`d"]).fit(df).stages[0].transform(df).collect()
    assert [tuple(r)[2:] for r in out] == [(-1.0, 1.0), (1.0, 0.0)]
