"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are permuted by md5 and laid end to end: a stream of
words that is read again from the start when a target asks for more than one
epoch. The stream is cut into blocks of equal size; a source's quota is the
number of its blocks that the mix takes. A splitting tree deals the quotas to
the output shards: at every node the blocks of the left half are a multivariate
hypergeometric draw from the node's quotas, so the quotas are met exactly and
each shard has a fair mixture. A shard takes the next run of each source's
permuted blocks, so no block is taken twice; rows are shuffled within the shard.

The tree holds one row per node with one quota per source (some thousand
sources at most); everything that grows with the documents is summed in cells
of one source and three md5 digits, so a source that holds a third of all rows
is spread over 4096 cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

WORD = r"[^\x20\x09-\x0D]+"
#: A source is read at most so often.
MAX_EPOCHS = 3
#: Output shards, and blocks for each of them.
SHARDS, BLOCKS_PER_SHARD = 16, 64
_CELL = 3


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def target_sizes(sources: DataFrame, weights: Sequence[float], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` with ``place`` (0-based, by code point, NULL last) and ``target``.

    Weights repeat along the order and share the sum of all sizes. A target
    stops at ``max_epochs`` sizes; the excess goes to the others by weight until
    none is above. In order of the ratio of limit to weight, that is the first
    source from which on the rest shares what the capped ones leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(w) for w in weights])
    placed = sources.withColumn("place", F.row_number().over(by_name) - 1)
    placed = placed.withColumn("w", F.element_at(given, (F.col("place") % len(weights) + 1).cast("int")))
    placed = placed.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "place")
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    share = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # From the first source on that the share of the rest does not lift above its limit, all are open.
    placed = placed.select("*", left.alias("left"), share.alias("share")).withColumn("ratio", F.col("cap") / F.col("w"))
    placed = placed.withColumn("open", F.col("left") * F.col("w") <= F.col("cap") * F.col("share"))
    first = F.min(F.when(F.col("open"), F.struct("ratio", "place", "left", "share"))).over(everything)
    placed = placed.withColumn("level", first)
    target = F.when(F.col("open"), F.col("level.left") * F.col("w") / F.col("level.share")).otherwise(F.col("cap"))
    return placed.select("source", "source_size", "place", target.cast("double").alias("target"))


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(shard, place, blocks)`` from ``(place, quota)``: the blocks each shard takes from each source.

    A node's quotas are split by going through its blocks source by source: a
    block goes left with the chance that the places still free on the left
    have among the blocks still to come. That draws the left half without
    replacement, so the split is multivariate hypergeometric and the numbers
    add up exactly. Chances come from a hash of the node and the block.
    """
    node = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "quota"))), lambda x: x["quota"]).alias("q"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("n"), "q")

    def left_share(lo: Column, n: Column, q: Column) -> Column:
        total = F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + x)
        want = F.floor(total * F.floor(n / 2) / n).cast("bigint")

        def draw(state: Column, x: Column) -> Column:
            def block(a: Column, i: Column) -> Column:
                chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), lo, n, F.size(state["taken"]), i), 11) / F.lit(float(2**53))
                left = (chance * a["total"] < a["want"]).cast("bigint")
                return F.struct((a["total"] - 1).alias("total"), (a["want"] - left).alias("want"))

            blocks = F.when(x > 0, F.sequence(F.lit(1).cast("bigint"), x)).otherwise(F.array().cast("array<bigint>"))
            after = F.aggregate(blocks, F.struct(state["total"].alias("total"), state["want"].alias("want")), block)
            taken = F.concat(state["taken"], F.array(state["want"] - after["want"]))
            return F.struct(after["total"].alias("total"), after["want"].alias("want"), taken.alias("taken"))

        zero = F.struct(total.alias("total"), want.alias("want"), F.array().cast("array<bigint>").alias("taken"))
        return F.aggregate(q, zero, draw)["taken"]

    width = shards
    while width > 1:
        split = node.withColumn("left", F.when(F.col("n") > 1, left_share(F.col("lo"), F.col("n"), F.col("q"))))
        half = F.floor(F.col("n") / 2).cast("int")
        rest = F.zip_with("q", "left", lambda a, b: a - b)
        children = F.when(
            F.col("n") > 1,
            F.array(
                F.struct(F.col("lo"), half.alias("n"), F.col("left").alias("q")),
                F.struct((F.col("lo") + half).alias("lo"), (F.col("n") - half).alias("n"), rest.alias("q")),
            ),
        ).otherwise(F.array(F.struct("lo", "n", "q")))
        node = split.select(F.explode(children).alias("c")).select("c.*")
        width = -(-width // 2)
    return node.select(F.col("lo").alias("shard"), F.posexplode("q").alias("place", "blocks"))


def draw_mix(
    docs: DataFrame,
    weights: Sequence[float],
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
    seed: int = 42,
    keep: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id, size, source_size, target, draws``.

    ``draws`` lists the copies that the mix takes: ``(copy, words, block,
    shard)``, ``words`` being the document's size but for the one document of a
    source that meets the target in its middle: its last copy is taken up to
    that word. So each source's words add up to its rounded target.
    With ``keep`` a struct ``row`` has all columns of ``docs``.

    Sources are keys of any number; NULL is one of them. A text of NULL or
    without words has size 0 and is never drawn. Repeated ids are separate
    rows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    columns = [
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_src"),
        F.md5(F.concat(F.lit(f"{seed}|"), named).cast("binary")).alias("_order"),
        F.xxhash64(F.col(text_col)).alias("_tie"),
    ]
    sized = stored(docs.select(*columns), "sized")
    cell = F.substring("_order", 1, _CELL)
    cells = stored(sized.groupBy("_src", "source", cell.alias("_cell")).agg(F.sum("size").alias("n")), "cells")
    totals = stored(cells.groupBy("_src", "source").agg(F.sum("n").alias("source_size")), "sources")
    targets = target_sizes(totals.drop("_src"), weights, max_epochs)
    targets = targets.withColumn("words", F.floor(F.col("target") + 0.5).cast("bigint"))
    block = F.greatest(F.ceil(F.sum("words").over(Window.partitionBy()) / F.lit(shards * BLOCKS_PER_SHARD)), F.lit(1)).cast("bigint")
    targets = targets.withColumn("block", block)
    targets = stored(targets.withColumn("quota", F.ceil(F.col("words") / F.col("block")).cast("bigint")), "targets")
    dealt = splitting_tree(targets.select("place", "quota"), shards, seed)
    starts = F.transform(F.sort_array(F.collect_list(F.struct("shard", "first"))), lambda x: x["first"])
    first = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("first", F.coalesce(F.sum("blocks").over(first), F.lit(0)))
    plan = targets.join(dealt.groupBy("place").agg(starts.alias("starts")), "place")
    plan = stored(plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_src"), "source_size", "target", "words", "block", "starts"), "plan")

    before = Window.partitionBy("_src").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_src", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = docs.select(*columns, F.struct(*docs.columns).alias("row")) if keep else sized
    rows = rows.withColumn("_cell", cell).join(offsets, ["_src", "_cell"])
    within = Window.partitionBy("_src", "_cell").orderBy("_order", "id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    # A few numbers per source; Spark broadcasts the table if its written size allows it.
    rows = rows.join(plan, "_src")

    def draw(copy: Column) -> Column:
        begin = copy * F.col("source_size") + F.col("_at")
        words = F.greatest(F.least(F.col("size"), F.col("words") - begin), F.lit(0))
        number = F.floor(begin / F.col("block")).cast("bigint")
        shard = F.size(F.filter(F.col("starts"), lambda s: s <= number)) - 1
        return F.struct(copy.alias("copy"), words.alias("words"), number.alias("block"), shard.alias("shard"))

    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), draw), lambda d: d["words"] > 0)
    return rows.select(
        "id", "size", "source_size", "target", draws.alias("draws"), *(["row"] if keep else [])
    )


def mixed_rows(drawn: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of the mix: one per draw, with ``copy``, ``words`` and ``shard``.

    ``whole`` rounds the document that a target meets in its middle: it is
    taken whole if at least half of it is within, else not.
    """
    rows = drawn.select("*", F.explode("draws").alias("_draw")).drop("draws")
    rows = rows.select("*", "_draw.copy", "_draw.words", "_draw.shard").drop("_draw")
    return rows.where(F.col("words") * 2 >= F.col("size")) if whole else rows


def write_mix(rows: DataFrame, path: str, seed: int = 42) -> None:
    """One folder per output shard, its rows shuffled by a hash of id and copy."""
    order = F.xxhash64(F.lit(seed), "shard", "id", "copy")
    shuffled = rows.withColumn("_order", order).repartition("shard").sortWithinPartitions("shard", "_order", "id", "copy")
    shuffled.drop("_order").write.partitionBy("shard").parquet(path)
