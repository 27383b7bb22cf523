import gzip
import json

from pyspark.sql import functions as F

from traitweave.operators import models as M
from traitweave.operators import prep
from traitweave.sources import ontology as OBO
from traitweave.sources import results as RES
from traitweave.sources import sequences as SEQ
from traitweave.sources import tables as S
from traitweave.workload import sources as workload_sources

TERMS = """format-version: 1.2

[Term]
id: GO:1
name: root

[Term]
id: GO:2
name: two
is_a: GO:1 ! root

[Term]
id: GO:3
name: three
is_a: GO:2 ! two
is_a: GO:1 ! root

[Typedef]
id: part_of
is_a: other
"""


def test_obo(spark, tmp_path, rows):
    (tmp_path / "go.obo").write_text(TERMS)
    assert rows(OBO.read_obo_edges(spark, str(tmp_path / "go.obo"))) == [("GO:2", "GO:1"), ("GO:3", "GO:1"), ("GO:3", "GO:2")]


def test_tsv_nulls(spark, tmp_path, rows):
    (tmp_path / "a.tsv").write_text("k\tv\ts\nx\t1.5\tNA\ny\tNA\tt\nz\t\tu\n")
    got = S.read_tsv(spark, str(tmp_path / "a.tsv"), "k STRING, v DOUBLE, s STRING")
    assert rows(got) == [("x", 1.5, None), ("y", None, "t"), ("z", None, "u")]


def test_typed_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Gene\ttpm_a\tgo_GO:1\tzzz_b\ng1\t1.5\t1\t2\n")
    got = S.read_feature_matrix(spark, str(tmp_path / "m.txt"), {"tpm_": "continuous", "go_": "categorical"})
    assert [t for _, t in got.dtypes] == ["string", "float", "tinyint", "double"]
    assert got.first()["go_GO:1"] == 1


def test_targets(spark, tmp_path, rows):
    (tmp_path / "t.txt").write_text("1\t|a b|\n2\tc\n")
    assert rows(S.read_targets(spark, str(tmp_path / "t.txt"), 1)) == [("a b",), ("c",)]


def test_labels_from_names(spark, tmp_path, rows):
    folder = tmp_path / "sleuth_output"
    folder.mkdir()
    (folder / "E1_sm.txt").write_text("t\tqval\nAT1.1\t0.01\n")
    (folder / "E2_1_sm.txt").write_text("t\tqval\nAT1.1\t0.5\n")
    got = S.read_labelled_dir(spark, str(folder), "t STRING, qval DOUBLE", S.BEFORE_SM)
    assert rows(got, "label", "qval") == [("E1", 0.01), ("E2_1", 0.5)]
    classes = tmp_path / "data_16"
    classes.mkdir()
    (classes / "GO_plastid.txt").write_text("Gene\tv\ng1\t1\n")
    assert rows(S.read_labelled_dir(spark, str(classes), "Gene STRING, v INT", S.AFTER_UNDERSCORE), "label") == [("plastid",)]


def test_run_info(spark, tmp_path, rows):
    for run, n in (("SRR1_kal_out", 5), ("SRR2_kal_out", 0), ("outdated_kal", 9)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "run_info.json").write_text(json.dumps({"n_targets": 3, "n_processed": n}, indent=2))
    assert rows(S.read_run_info(spark, f"{tmp_path}/*/run_info.json")) == [("SRR1", 5), ("SRR2", 0)]


def test_sequences(spark, tmp_path, rows):
    with gzip.open(tmp_path / "ath.fa.gz", "wt") as out:
        out.write(">g1\nMKL*\n")
    assert rows(SEQ.clean_sequences(spark, f"{tmp_path}/*.gz")) == [("ath", ">g1"), ("ath", "MKL")]


def test_results_and_names(spark, tmp_path, rows):
    df = spark.createDataFrame([("go_GO:1", 0.5), ("go_GO:2", 0.25)], "target STRING, f1 DOUBLE")
    RES.write_results(df, str(tmp_path / "r"))
    assert rows(RES.read_results(spark, str(tmp_path / "r")), "target", "f1") == [("go_GO_1", 0.5), ("go_GO_2", 0.25)]


def test_saved_pipeline(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i % 2, float(i % 2)) for i in range(40)], "x DOUBLE, c INT, label DOUBLE")
    model = prep.preprocessor(["x"], ["c"], M.decision_tree(3)).fit(df)
    RES.save_model(model, str(tmp_path / "m"))
    again = RES.load_model(str(tmp_path / "m"))
    wrong = again.transform(df).where(F.col("prediction") != F.col("label")).count()
    assert wrong == 0


def test_folders_of_runs_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(u, f'{{"k": {u + i}}}') for u in range(12) for i in range(2)], "user_id bigint, props string").write.parquet(str(tmp_path / "sf/events.parquet"))
    monkeypatch.setattr(workload_sources, "scratch", lambda spark, name: str(tmp_path / name))
    found = workload_sources._run_info(spark, str(tmp_path / "sf")).collect()
    assert [(r["run"], r["n_processed"]) for r in found] == [(str(u), 2 * u + 1) for u in range(12)]
    files = list((tmp_path / "runs").glob("*/*.json"))
    assert len(files) == 12 and len({f.name.split("-")[1] for f in files}) > 1
