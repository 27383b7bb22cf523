"""Edge-list operators: clustering, components, symmetry."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Nodes of a connected part of a network whose flow matrix a task holds whole (twice eight bytes a cell).
PART_NODES = 1000


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Directed edges without an equal edge in the other direction.

    Both directions meet in one group, so the edges are shuffled once.
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    forward = F.col("src") <= F.col("dst")
    each = edges.groupBy(lo.alias("lo"), hi.alias("hi"), "w").agg(
        F.bool_or(forward).alias("up"), F.bool_or(~forward).alias("down")
    )
    single = each.where("lo <> hi and up <> down")
    return single.select(
        F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")).alias("src"),
        F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo")).alias("dst"),
        "w",
    )


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, component)``, the component named by its smallest node.

    Alternates the two star steps: every node first links its larger
    neighbours, then its smaller neighbours, to the smallest one. The number of
    rounds grows with the logarithm of the component, not with its diameter.
    The minimum per node is combined before the shuffle, so a hub is one row.
    """
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links, seen = checkpointed(links.where("u <> v").distinct()), None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        links = checkpointed(small.distinct())
        # Two rounds with the same set of links: compared by its size and an order-free sum of hashes.
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(links.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def _normalised(cells: DataFrame) -> DataFrame:
    """Divide by the column sums."""
    sums = cells.groupBy("j").agg(F.sum("p").alias("s"))
    return cells.join(sums, "j").select("i", "j", (F.col("p") / F.col("s")).alias("p"))


def flow_matrix(edges: DataFrame) -> DataFrame:
    """The column-stochastic matrix ``(i, j, p)`` of an undirected network; every node gets a loop as heavy as its heaviest edge."""
    both = edges.unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    )
    weights = both.where("src <> dst").groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(
        F.max("w").cast("double").alias("p")
    )
    loops = weights.groupBy("j").agg(F.max("p").alias("p")).select(F.col("j").alias("i"), "j", "p")
    alone = edges.where("src = dst").select(F.col("src").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("p"))
    alone = alone.distinct().join(loops.select("i"), "i", "left_anti").select("i", "j", "p")
    return _normalised(weights.unionByName(loops).unionByName(alone))


def flow_round(cells: DataFrame, inflation: float = 2.0, eps: float = 1e-5) -> DataFrame:
    """One round: the matrix times itself, every cell to the power of ``inflation``, columns pruned and made stochastic.

    ``(i, j, p, part)``: the connected part of the network is found once, in the first round.
    """
    return _in_parts(cells, lambda large: _round(large, inflation, eps), lambda p: (_flown(p, inflation, eps), True))[0]


def _round(cells: DataFrame, inflation: float, eps: float) -> DataFrame:
    left = cells.select("i", F.col("j").alias("k"), F.col("p").alias("a"))
    right = cells.select(F.col("i").alias("k"), "j", F.col("p").alias("b"))
    squared = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("p"))
    inflated = _normalised(squared.withColumn("p", F.pow("p", F.lit(float(inflation)))))
    return checkpointed(_normalised(_pruned(checkpointed(inflated), eps)))


def _flown(p: np.ndarray, inflation: float, eps: float) -> np.ndarray:
    """``_round`` of a matrix without gaps."""
    p = _stochastic((p @ p) ** inflation)
    return _stochastic(np.where((p >= eps) | (p >= p.max(axis=0) * (1 - 1e-9)), p, 0.0))


def _stochastic(p: np.ndarray) -> np.ndarray:
    total = p.sum(axis=0)
    return np.divide(p, total, out=np.zeros_like(p), where=total > 0)


def _in_parts(cells: DataFrame, whole: Callable[[DataFrame], DataFrame], part: Callable[[np.ndarray], tuple[np.ndarray, bool]]) -> tuple[DataFrame, bool]:
    """A function of a flow matrix, worked out for each connected part of the network on its own.

    No path leads from one part to another, so no round mixes their cells. Parts
    of up to ``PART_NODES`` nodes go through ``part``, a matrix in a task each, and leave
    only their own cells; larger ones, and any with cells that are not above 0, go
    through ``whole`` together. Also says whether ``part`` was content with all.
    """
    cells = checkpointed(cells)
    if not cells.where("i is null or j is null").isEmpty():
        return whole(cells.select("i", "j", "p")).withColumn("part", F.lit(None).cast(cells.schema["i"].dataType)), True
    if "part" not in cells.columns:
        named = components(cells.select(F.col("i").alias("src"), F.col("j").alias("dst")))
        cells = checkpointed(cells.join(named.withColumnsRenamed({"node": "j", "component": "part"}), "j").select("i", "j", "p", "part"))
    sizes = cells.groupBy("part").agg(F.count_distinct("j").alias("n"), F.bool_and(F.coalesce(F.col("p") > 0, F.lit(False))).alias("good"))
    large = checkpointed(sizes.where(~F.col("good") | (F.col("n") > PART_NODES)).select("part"))
    few, rest = cells, None
    if not large.isEmpty():
        few, many = cells.join(large, "part", "left_anti"), cells.join(large, "part", "left_semi")
        rest = whole(many.select("i", "j", "p")).join(many.select("j", "part").distinct(), "j").select("i", "j", "p", "part")
    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("i", "j", "p", "part"))

    def worked(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([rows["i"].to_numpy(), rows["j"].to_numpy()]), return_inverse=True)
        p = np.zeros((len(nodes), len(nodes)))
        p[at[:len(rows)], at[len(rows):]] = rows["p"].to_numpy()
        p, content = part(p)
        i, j = np.nonzero(p)
        return pd.DataFrame({"i": nodes[i], "j": nodes[j], "p": p[i, j], "part": rows["part"].iloc[0], "content": content})

    done = checkpointed(few.groupBy("part").applyInPandas(worked, f"{kinds}, content boolean"))
    content = done.where("not content").isEmpty()
    done = done.drop("content")
    return (done if rest is None else done.unionByName(rest)), content


def mcl(
    edges: DataFrame, inflation: float = 2.0, eps: float = 1e-5, max_iter: int = 100, tol: float = 1e-6
) -> DataFrame:
    """Markov clustering: ``(node, cluster)``, the cluster named by its smallest node.

    The column-stochastic matrix is kept as cells ``(i, j, p)``. Cells below
    ``eps`` are pruned, but the largest cells of a column always stay: a flat
    column keeps all its cells, so no node is lost. Every node of the input is
    in the result. Raises if the columns have not settled after ``max_iter``
    rounds. A connected part of the network ends its rounds when its own columns
    have settled.
    """

    def whole(cells: DataFrame) -> DataFrame:
        for _ in range(max_iter):
            cells = _round(cells, inflation, eps)
            # A column has settled when all its cells are equal.
            spread = cells.groupBy("j").agg((F.max("p") - F.sum(F.col("p") * F.col("p"))).alias("d"))
            if (spread.agg(F.max("d")).first()[0] or 0.0) < tol:
                return cells
        raise RuntimeError(f"Markov clustering did not settle in {max_iter} rounds")

    def part(p: np.ndarray) -> tuple[np.ndarray, bool]:
        for _ in range(max_iter):
            p = _flown(p, inflation, eps)
            if (p.max(axis=0) - (p * p).sum(axis=0)).max() < tol:
                return p, True
        return p, False

    cells, settled = _in_parts(flow_matrix(edges), whole, part)
    if not settled:
        raise RuntimeError(f"Markov clustering did not settle in {max_iter} rounds")
    # Columns and the rows that attract them form the clusters.
    linked = components(_pruned(cells, eps).select(F.col("i").alias("src"), F.col("j").alias("dst")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def _pruned(cells: DataFrame, eps: float) -> DataFrame:
    """Drop cells below ``eps``, but never the largest of a column (cells equal to it up to rounding)."""
    largest = cells.groupBy("j").agg(F.max("p").alias("_most"))
    small = F.col("p") < F.lit(eps)
    return cells.join(largest, "j").where(~small | (F.col("p") >= F.col("_most") * F.lit(1 - 1e-9))).drop("_most")
