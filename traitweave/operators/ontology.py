"""Transitive closure of a term graph and leak-safe feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import BROADCAST_ROWS, broadcast_small
from ..session import checkpointed

# Every how many rounds the closure found so far is merged into one table.
MERGE_EVERY = 8
# A layer of terms that nothing is below is set aside if it has at least one in so many of the edges left.
LAYER_SHARE = 8
# With at least one target in so many edges, most of the graph is related to one.
MANY_TARGETS = 8
# Relatives among given features are found from the features if there are at most so many of them per target.
FEATURES_PER_TARGET = 8


def _steps(edges: DataFrame, sides: Sequence[str]) -> DataFrame:
    """``(side, term, relative)``: the edges read upwards, downwards or both."""
    once = edges.select("child", "parent").where("child <> parent").distinct()
    up = F.struct(F.lit("ancestor").alias("side"), F.col("child").alias("term"), F.col("parent").alias("relative"))
    down = F.struct(F.lit("descendant").alias("side"), F.col("parent").alias("term"), F.col("child").alias("relative"))
    read = [{"ancestor": up, "descendant": down}[s] for s in sides]
    return checkpointed(once.select(F.explode(F.array(*read)).alias("s")).select("s.*"))


def _walk(steps: DataFrame, found: DataFrame) -> DataFrame:
    """Everything reached from ``found`` along ``steps``.

    Semi-naive: each round joins only the pairs found in the round before with
    the steps and keeps those not seen yet. Every round is written out, so the
    plan stays short and a lost executor costs no more than one round.
    """
    onwards = broadcast_small(steps, steps.count()).select("side", F.col("term").alias("relative"), F.col("relative").alias("next"))
    frontier, rounds = found, 0
    while True:
        reached = frontier.join(onwards, ["side", "relative"]).select("side", "term", F.col("next").alias("relative"))
        reached = reached.where("term <> relative").distinct()
        frontier = checkpointed(reached.join(found, ["side", "term", "relative"], "left_anti"))
        if frontier.isEmpty():
            return found
        found, rounds = found.unionByName(frontier), rounds + 1
        if rounds % MERGE_EVERY == 0:
            found = checkpointed(found)


def _doubled(once: DataFrame) -> DataFrame:
    """All ``(term, relative)`` with ``relative`` above ``term`` along the distinct steps ``once``.

    Paths double: after round k all pairs up to 2^k steps apart are known with
    their distance. A pair further apart has a term exactly 2^k steps above it on a
    shortest path, so only the pairs at exactly that distance are joined with the
    known ones, and a graph of depth d is done after log2(d) rounds. Distances
    also end the rounds on cycles.
    """
    found, reach = checkpointed(once.withColumn("d", F.lit(1))), 1
    while True:
        last = found.where(F.col("d") == reach)
        n = last.count()
        if not n:
            return found.select("term", "relative")
        first = broadcast_small(last, n).select("term", F.col("relative").alias("by"))
        onwards = found.select(F.col("term").alias("by"), "relative", (F.col("d") + reach).alias("d"))
        longer = first.join(onwards, "by").select("term", "relative", "d").where("term <> relative")
        nearest = found.unionByName(longer).groupBy("term", "relative").agg(F.min("d").alias("d"))
        found, reach = checkpointed(nearest), 2 * reach


def _lists(edges: DataFrame, small: int) -> DataFrame:
    """``(term, above)``: one row per term with a parent, and all that is above it.

    Terms that nothing is below are set aside, layer by layer, as long as a layer
    is a good share of what is left: they lie on no cycle, and once the terms above
    them are known, one join completes them. So most pairs are made, shuffled and
    written once. What is left, cycles among it, is small or deep and doubles its paths.
    """
    once = edges.select(F.col("child").alias("term"), F.col("parent").alias("relative")).where("term <> relative").distinct()
    rest, layers = checkpointed(once), []
    n = rest.count()
    while n > small:
        inner = checkpointed(rest.select(F.col("relative").alias("term")).distinct())
        kept = checkpointed(rest.join(inner, "term", "left_semi"))
        left = kept.count()
        if (n - left) * LAYER_SHARE < n:
            break
        layers.append(rest.join(inner, "term", "left_anti"))
        rest, n = kept, left
    known = checkpointed(_doubled(rest).groupBy("term").agg(F.collect_list("relative").alias("above")))
    for layer in reversed(layers):
        met = layer.join(known.withColumnRenamed("term", "relative"), "relative", "left")
        parts = met.select("term", F.array_append(F.coalesce("above", F.array().cast("array<string>")), F.col("relative")).alias("part"))
        known = known.unionByName(checkpointed(parts.groupBy("term").agg(F.array_distinct(F.flatten(F.collect_list("part"))).alias("above"))))
    return known


def ancestors(edges: DataFrame, small: int = BROADCAST_ROWS) -> DataFrame:
    """All ``(term, relative)`` with ``relative`` above ``term``. Graphs of up to ``small`` edges are not cut into layers."""
    named = edges.select(F.col("child").cast("string"), F.col("parent").cast("string"))
    pairs = _lists(named, small).select("term", F.explode("above").alias("relative"))
    kinds = edges.schema["child"].dataType, edges.schema["parent"].dataType
    return pairs.select(F.col("term").cast(kinds[0]).alias("term"), F.col("relative").cast(kinds[1]).alias("relative"))


def closure(edges: DataFrame, direction: str = "both") -> DataFrame:
    """``(term, relative, side)`` with side ``ancestor`` or ``descendant``.

    Descendants are the ancestor pairs read the other way round.
    """
    up = ancestors(edges)
    sides = {
        "ancestors": up.withColumn("side", F.lit("ancestor")),
        "descendants": up.select(
            F.col("relative").alias("term"), F.col("term").alias("relative"), F.lit("descendant").alias("side")
        ),
    }
    if direction == "both":
        return sides["ancestors"].unionByName(sides["descendants"])
    return sides[direction]


def _related(edges: DataFrame, terms: DataFrame, small: int) -> DataFrame:
    """``(term, relative)``: what is above and below the ``terms``, from the closure of the graph."""
    lists = checkpointed(_lists(edges, small))
    above = lists.join(terms, "term", "left_semi").select("term", F.explode("above").alias("relative"))
    below = lists.select(F.explode("above").alias("term"), F.col("term").alias("relative")).join(terms, "term", "left_semi")
    return above.unionByName(below)


def _terms(names: DataFrame, col: str, prefix: str) -> DataFrame:
    """``(term)``: the names with the prefix, without it."""
    some = names.select(col).where(F.col(col).startswith(prefix)).distinct()
    return checkpointed(some.select(F.substring(F.col(col), len(prefix) + 1, 2**31 - 1).alias("term")))


def _related_among(edges: DataFrame, terms: DataFrame, others: DataFrame) -> DataFrame:
    """``(term, relative)``: those of the ``others`` that are above and below the ``terms``.

    What is below a term has the term above it, so all walks go upwards: from
    few names they stay small, however much of the graph is below the terms.
    """
    steps = _steps(edges, ["ancestor"])
    walked = _walk(steps, checkpointed(steps.join(terms.unionByName(others).distinct(), "term", "left_semi")))
    above = walked.select("term", "relative").join(terms, "term", "left_semi")
    below = walked.select(F.col("relative").alias("term"), F.col("term").alias("relative")).join(terms, "term", "left_semi")
    return above.unionByName(below).join(others.withColumnRenamed("term", "relative"), "relative", "left_semi").select("term", "relative")


def exclusions(
    targets: DataFrame, edges: DataFrame, include_self: bool = False, prefix: str = "go_", small: int = BROADCAST_ROWS, features: DataFrame | None = None
) -> DataFrame:
    """``(target, feature)``: what each target's training set must not contain.

    Made for all targets at once; only what is above or below a target is
    walked, or, for targets all over the graph, its closure is made and read. Targets are feature names; their terms are the names without the
    prefix. With ``features`` ``(feature)`` only those are listed.
    """
    terms = _terms(targets, "target", prefix)
    named = edges.select(F.col("child").cast("string"), F.col("parent").cast("string"))
    others = None if features is None else _terms(features, "feature", prefix)
    n_terms = terms.count()
    if others is not None and others.count() <= n_terms * FEATURES_PER_TARGET:
        related = _related_among(named, terms, others)
    elif n_terms * MANY_TARGETS >= named.count():
        related = _related(named, terms, small)
    else:
        steps = _steps(named, ["ancestor", "descendant"])
        related = _walk(steps, checkpointed(steps.join(terms, "term", "left_semi")))
    full = [F.concat(F.lit(prefix), F.col(c)) for c in ("term", "relative")]
    relatives = related.select(full[0].alias("target"), full[1].alias("feature"))
    if include_self:
        relatives = relatives.unionByName(targets.select("target", F.col("target").alias("feature")))
    if features is not None:
        relatives = relatives.join(features.select("feature").distinct(), "feature", "left_semi").select("target", "feature")
    return relatives.distinct()


def mate_exclusions(targets: DataFrame) -> DataFrame:
    """The same table for regulation targets: ``X_up`` excludes ``X_down``."""
    return targets.select("target", C.complement_name("target").alias("feature")).distinct()


def leak_safe(long: DataFrame, excluded: DataFrame, target: str) -> DataFrame:
    """The matrix without the features excluded for one target.

    A target with no exclusions keeps every feature.
    """
    names = excluded.where(F.col("target") == target).select("feature")
    return long.join(names, "feature", "left_anti").select(*long.columns)


def kept_features(features: DataFrame, excluded: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: how many features stay and how many are removed."""
    present = excluded.join(features.select("feature").distinct(), "feature", "left_semi")
    removed = present.groupBy("target").agg(F.count(F.lit(1)).alias("n_removed"))
    total = features.agg(F.count_distinct("feature")).scalar()
    counted = targets.select("target").distinct().join(removed, "target", "left").na.fill(0, ["n_removed"])
    return counted.withColumn("n_kept", total - F.col("n_removed"))
