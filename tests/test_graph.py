import random

import numpy as np
import pytest

from traitweave.operators import graph as G
from traitweave.operators import ontology as T
from traitweave.operators import orthogroups as O


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "child STRING, parent STRING")


def test_closure(spark, rows):
    edges = _edges(spark, [("b", "a"), ("c", "b"), ("d", "b"), ("c", "a")])
    got = rows(T.closure(edges))
    assert [r for r in got if r[0] == "c" and r[2] == "ancestor"] == [("c", "a", "ancestor"), ("c", "b", "ancestor")]
    assert [r[1] for r in got if r[0] == "a" and r[2] == "descendant"] == ["b", "c", "d"]
    assert len(got) == len(set(got)) == 10


def test_closure_with_cycle_and_depth(spark, rows):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)] + [("x", "y"), ("y", "x")]
    got = set(rows(T.ancestors(_edges(spark, chain))))
    want = {(f"n{i:02d}", f"n{j:02d}") for i in range(13) for j in range(i + 1, 13)} | {("x", "y"), ("y", "x")}
    assert got == want


def test_leak_safe(spark, rows):
    edges = _edges(spark, [("b", "a"), ("c", "b"), ("d", "b"), ("c", "a")])
    long = spark.createDataFrame(
        [("g", f, 1.0) for f in ("go_a", "go_b", "go_c", "go_d", "pfa_x")], "key STRING, feature STRING, value DOUBLE"
    )
    targets = spark.createDataFrame([("go_b",)], "target STRING")
    excluded = T.exclusions(targets, edges, include_self=True)
    assert rows(T.leak_safe(long, excluded, "go_b"), "feature") == [("pfa_x",)]
    assert rows(T.kept_features(long, excluded, targets)) == [("go_b", 4, 1)]
    mates = T.mate_exclusions(spark.createDataFrame([("dge_X_up",)], "target STRING"))
    assert rows(mates) == [("dge_X_up", "dge_X_down")]


def test_components(spark, rows):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0), (6, 6, 1.0)], "src INT, dst INT, w DOUBLE")
    assert rows(G.components(df)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]


def test_components_random(spark, rows):
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src INT, dst INT, w DOUBLE")
    assert dict(rows(G.components(df))) == {n: find(n) for n in root}


def test_asymmetric(spark, rows):
    df = spark.createDataFrame([("1", "2", 0.5), ("3", "4", 0.1), ("4", "3", 0.1), ("5", "6", 0.1), ("6", "5", 0.2)], "src STRING, dst STRING, w DOUBLE")
    assert rows(G.asymmetric_edges(df)) == [("1", "2", 0.5), ("5", "6", 0.1), ("6", "5", 0.2)]


def _mcl_dense(pairs, n, inflation, eps, rounds=100):
    m = np.zeros((n, n))
    for a, b, w in pairs:
        m[a, b] = m[b, a] = max(m[a, b], w)
    np.fill_diagonal(m, m.max(axis=0))
    m /= m.sum(axis=0)
    for _ in range(rounds):
        new = (m @ m) ** inflation
        new /= new.sum(axis=0)
        new[new < eps] = 0
        new /= new.sum(axis=0)
        done = np.abs(new - m).max() < 1e-6
        m = new
        if done:
            break
    label = list(range(n))
    for _ in range(n):
        for i, j in zip(*np.nonzero(m > eps)):
            label[i] = label[j] = min(label[i], label[j])
    return dict(enumerate(label))


def test_mcl_against_dense(spark, rows):
    pairs = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 0.8), (2, 3, 0.1), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 0.9)]
    df = spark.createDataFrame(pairs, "src INT, dst INT, w DOUBLE")
    assert dict(rows(G.mcl(df, 2.0))) == _mcl_dense(pairs, 6, 2.0, 1e-5)


OG = [("o1", "A", "a1"), ("o1", "B", "b1"), ("o1", "C", "c1"), ("o2", "A", "a2"), ("o2", "A", "a3"), ("o2", "B", "b2"), ("o3", "A", "a4"), ("o4", "C", "c2"), ("o4", "C", "c3")]


def test_orthogroup_tables(spark, rows):
    og = spark.createDataFrame(OG, "orthogroup STRING, species STRING, gene STRING")
    genes = og.select("species", "gene")
    assert rows(O.single_copy(og)) == [("o1",)]
    assert rows(O.unassigned(genes, og), "gene") == [("a4",)]
    assert rows(O.gene_counts(og, ["A", "B", "C"])) == [("o1", 1, 1, 1), ("o2", 2, 1, 0), ("o3", 1, 0, 0), ("o4", 0, 0, 2)]
    overlap = {r[:2]: r[2] for r in rows(O.species_overlap(og))}
    assert overlap[("A", "B")] == 2 and overlap[("A", "C")] == 1 and overlap[("A", "A")] == 3 and overlap[("C", "C")] == 2
    stats = {r["species"]: r for r in O.og_statistics(og, genes).collect()}
    assert (stats["A"]["n_genes"], stats["A"]["n_assigned"], stats["A"]["n_unassigned"]) == (4, 3, 1)
    assert (stats[None]["n_genes"], stats[None]["n_assigned"], stats[None]["n_specific"]) == (9, 8, 1)
    assert (stats["C"]["n_specific"], stats["C"]["n_genes_specific"]) == (1, 2)


def test_g50(spark, rows):
    sizes = [5, 3, 1, 1]
    data = [(f"o{i}", "A", f"g{i}_{j}") for i, n in enumerate(sizes) for j in range(n)]
    assert rows(O.g50_o50(spark.createDataFrame(data, "orthogroup STRING, species STRING, gene STRING"))) == [(5, 1)]


def test_multiplicity(spark, rows):
    pairs = [("A", "a1", "B", "b1"), ("A", "a2", "B", "b2"), ("A", "a2", "B", "b3"), ("A", "a4", "B", "b4"), ("A", "a4", "B", "b5"), ("A", "a5", "B", "b4"), ("A", "a5", "B", "b5")]
    df = spark.createDataFrame(pairs, "species_a STRING, gene_a STRING, species_b STRING, gene_b STRING")
    assert rows(O.ortholog_multiplicity(df)) == [("A", "B", 1, 0, 1, 2, 4), ("B", "A", 1, 2, 0, 2, 5)]


@pytest.mark.parametrize("most", [10, 0])
def test_multiplicity_without_a_join_and_with_hot_genes(spark, rows, monkeypatch, most):
    """Repeated and mirrored pairs and missing names count the same, whether pairs meet in one shuffle or a gene has too many and is joined."""
    monkeypatch.setattr(O, "MAX_GROUP_ROWS", most)
    names = "species_a STRING, gene_a STRING, species_b STRING, gene_b STRING"
    pairs = [("A", "a1", "B", "b1"), ("A", "a1", "B", "b1"), ("A", "a2", "B", "b1"), ("B", "b1", "A", "a1"), ("A", "a3", "A", "a4"), ("A", "a4", "A", "a3"), ("A", None, "B", "b2"), (None, "x", "B", "b3")]
    found = O.ortholog_multiplicity(spark.createDataFrame(pairs, names))
    assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == (most == 0)
    assert rows(found) == [("A", "A", 2, 0, 0, 0, 2), ("A", "B", 1, 2, 0, 0, 3), ("B", "A", 0, 0, 1, 0, 1)]


def test_duplications(spark, rows):
    events = spark.createDataFrame([("o1", "N1"), ("o1", "N2"), ("o2", "N1")], "orthogroup STRING, node STRING")
    assert rows(O.duplication_counts(events)) == [("node", "N1", 2), ("node", "N2", 1), ("orthogroup", "o1", 2), ("orthogroup", "o2", 1)]


def test_mcl_loses_no_node(spark):
    clique = spark.createDataFrame([(i, j, 1.0) for i in range(25) for j in range(i)], "src INT, dst INT, w DOUBLE")
    out = G.mcl(clique, 2.0, eps=0.05).collect()
    assert len(out) == 25 and {r["cluster"] for r in out} == {0}
    with pytest.raises(RuntimeError, match="settle"):
        G.mcl(spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.7), (2, 3, 1.0)], "src INT, dst INT, w DOUBLE"), 1.1, max_iter=1)


def test_parts_of_a_flow_are_worked_out_alone(spark, rows, monkeypatch):
    """A part in a task says the same as the rounds of joins, and only parts that are too large, or odd, take those."""
    rnd = random.Random(3)
    pairs = [(f"{c}{rnd.randint(0, 7)}", f"{c}{rnd.randint(0, 7)}", rnd.random() + 0.1) for c in "abc" for _ in range(12)] + [("x", "x", 1.0)]
    edges = spark.createDataFrame(pairs, "src STRING, dst STRING, w DOUBLE")
    met = []
    whole = G._round
    monkeypatch.setattr(G, "_round", lambda cells, *a: met.append(cells.count()) or whole(cells, *a))
    cells = G.flow_matrix(edges)
    alone, clusters = rows(G.flow_round(G.flow_round(cells)), "i", "j", "p"), rows(G.mcl(edges))
    assert not met
    monkeypatch.setattr(G, "PART_NODES", 0)
    assert rows(G.flow_round(G.flow_round(cells)), "i", "j", "p") == alone and met
    assert rows(G.mcl(edges)) == clusters


def test_a_flow_with_null_nodes_or_zero_cells(spark, rows):
    cells = spark.createDataFrame([("a", "a", 0.0), ("b", "a", 1.0), ("a", "b", 0.5), ("b", "b", 0.5), ("c", "c", 1.0)], "i STRING, j STRING, p DOUBLE")
    assert rows(G.flow_round(cells), "i", "j", "p") == rows(G._round(cells, 2.0, 1e-5))
    holes = cells.unionByName(spark.createDataFrame([(None, "a", 0.5)], "i STRING, j STRING, p DOUBLE"))
    assert rows(G.flow_round(holes), "i", "j", "p") == rows(G._round(holes, 2.0, 1e-5))


def _layered(spark):
    """A deep graph with several parents a term, and a cycle on top with terms below it."""
    pairs = [(f"n{i}", f"n{i // d}") for i in range(1, 80) for d in (2, 3)] + [("n0", "x"), ("x", "y"), ("y", "x"), ("y", "z"), ("n5", "n5"), (None, "x"), ("x", None)]
    up = {}
    for a, b in pairs:
        if a != b and a is not None and b is not None:
            up.setdefault(a, set()).add(b)

    def above(t):
        seen, at = set(), list(up.get(t, ()))
        while at:
            t2 = at.pop()
            if t2 not in seen:
                seen.add(t2)
                at += up.get(t2, ())
        return seen - {t}

    return _edges(spark, pairs), {(t, r) for t in up for r in above(t)}


def test_layers_of_a_closure(spark, rows, monkeypatch):
    """Terms that nothing is below are set aside: the doubled paths are those of the few terms left."""
    edges, want = _layered(spark)
    doubled, sizes = T._doubled, []
    monkeypatch.setattr(T, "_doubled", lambda once: sizes.append(once.count()) or doubled(once))
    got = rows(T.ancestors(edges, small=0))
    assert len(got) == len(set(got)) and set(got) == want
    assert sizes[0] < 20


def test_exclusions_of_many_targets_come_from_the_closure(spark, rows, monkeypatch):
    edges, pairs = _layered(spark)
    names = [f"n{i}" for i in range(0, 80, 2)] + ["x", "away"]
    targets = spark.createDataFrame([(f"go_{t}",) for t in names] + [("pfa_1",)], "target STRING")
    want = {(f"go_{t}", f"go_{r}") for a, b in pairs for t, r in ((a, b), (b, a)) if t in names} | {(f"go_{t}", f"go_{t}") for t in names} | {("pfa_1", "pfa_1")}
    walked = rows(T.exclusions(targets.limit(1000), edges, True))
    monkeypatch.setattr(T, "_walk", None)
    got = rows(T.exclusions(targets, edges, True, small=0))
    assert len(got) == len(set(got)) and set(got) == want == set(walked)


def test_exclusions_among_features_walk_upwards_only(spark, rows, monkeypatch):
    """However much is below a target, only the given features and what is above them is looked at."""
    edges, pairs = _layered(spark)
    names, few = ["n0", "n2", "n40", "x", "away"], ["n1", "n2", "n41", "n60", "x", "nowhere"]
    targets = spark.createDataFrame([(f"go_{t}",) for t in names] + [("pfa_1",)], "target STRING")
    features = spark.createDataFrame([(f"go_{f}",) for f in few] + [("pfa_1",), (None,)], "feature STRING")
    want = {(f"go_{t}", f"go_{r}") for a, b in pairs for t, r in ((a, b), (b, a)) if t in names and r in few}
    want |= {(f"go_{t}", f"go_{t}") for t in names if t in few} | {("pfa_1", "pfa_1")}
    monkeypatch.setattr(T, "FEATURES_PER_TARGET", 0)
    assert set(rows(T.exclusions(targets, edges, True, features=features))) == want
    monkeypatch.setattr(T, "FEATURES_PER_TARGET", 8)
    steps, sides = T._steps, []
    monkeypatch.setattr(T, "_steps", lambda edges, some: sides.append(list(some)) or steps(edges, some))
    got = rows(T.exclusions(targets, edges, True, features=features))
    assert len(got) == len(set(got)) and set(got) == want and sides == [["ancestor"]]
