"""Tables derived from orthogroups ``(orthogroup, species, gene)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import MAX_GROUP_ROWS
from .ranking import cumulative_share

# Cells in which the pairs of genes are counted to see whether one gene has too many for a task.
GENE_CELLS = 65_536


def _cells(og: DataFrame) -> DataFrame:
    """Genes per orthogroup and species; everything below starts from this."""
    return og.groupBy("orthogroup", "species").agg(F.count(F.lit(1)).alias("n"))


def gene_counts(og: DataFrame, species: Sequence | None = None) -> DataFrame:
    """Long ``(orthogroup, species, n)``, or one column per listed species."""
    cells = _cells(og)
    if species is None:
        return cells
    wide = cells.groupBy("orthogroup").pivot("species", list(species)).agg(F.sum("n"))
    return wide.na.fill(0)


def single_copy(og: DataFrame) -> DataFrame:
    """Orthogroups with exactly one gene in every species."""
    cells = _cells(og)
    n_species = og.agg(F.count_distinct("species")).scalar()
    each = cells.groupBy("orthogroup").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most"))
    return each.where((F.col("most") == 1) & (F.col("k") == n_species)).select("orthogroup")


def unassigned(genes: DataFrame, og: DataFrame) -> DataFrame:
    """Genes in no orthogroup with other genes."""
    shared = og.groupBy("orthogroup").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = og.join(shared, "orthogroup", "left_semi").select("gene")
    return genes.join(placed, "gene", "left_anti").select(*genes.columns)


def species_overlap(og: DataFrame) -> DataFrame:
    """Number of orthogroups shared by each ordered species pair.

    Orthogroups with the same set of species are counted first; pairs are
    formed once per set instead of once per orthogroup.
    """
    sets = og.select("orthogroup", "species").distinct().groupBy("orthogroup").agg(
        F.sort_array(F.collect_list("species")).alias("members")
    )
    patterns = sets.groupBy("members").agg(F.count(F.lit(1)).alias("n"))
    first = patterns.select("members", "n", F.explode("members").alias("species_a"))
    pairs = first.select("species_a", F.explode("members").alias("species_b"), "n")
    return pairs.groupBy("species_a", "species_b").agg(F.sum("n").alias("n_orthogroups"))


def og_statistics(og: DataFrame, genes: DataFrame) -> DataFrame:
    """Statistics per species, and over all species (species NULL).

    ``genes`` lists every gene ``(species, gene)``; those outside orthogroups
    of two or more genes count as unassigned.
    """
    cells = _cells(og)
    size = cells.groupBy("orthogroup").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("k"))
    size = size.where("size > 1")

    def counted(n: str) -> list:
        # A row is one orthogroup, so nothing has to be made distinct.
        return [
            F.sum(n).alias("n_assigned"), F.count(F.lit(1)).alias("n_orthogroups"), F.count_if(F.col("k") == 1).alias("n_specific"),
            F.sum(F.when(F.col("k") == 1, F.col(n)).otherwise(0)).alias("n_genes_specific"),
        ]

    each = cells.join(size, "orthogroup").groupBy("species").agg(*counted("n")).withColumn("g", F.lit(0).cast("tinyint"))
    overall = size.agg(*counted("size")).where("n_orthogroups > 0").select(
        F.lit(None).cast(cells.schema["species"].dataType).alias("species"), "*", F.lit(1).cast("tinyint").alias("g")
    )
    cubed = each.unionByName(overall)
    totals = genes.groupingSets([("species",), ()], "species").agg(
        F.grouping("species").alias("g"), F.count(F.lit(1)).alias("n_genes")
    )
    names = ["n_assigned", "n_orthogroups", "n_specific", "n_genes_specific"]
    both = totals.alias("t").join(
        cubed.alias("c"),
        (F.col("t.g") == F.col("c.g")) & F.col("t.species").eqNullSafe(F.col("c.species")),
        "left",
    )
    out = both.select(
        "t.species", "n_genes", *[F.coalesce(c, F.lit(0)).alias(c) for c in names]
    )
    return out.withColumns(
        {
            "n_unassigned": F.col("n_genes") - F.col("n_assigned"),
            "share_assigned": F.col("n_assigned") / F.col("n_genes"),
        }
    )


def g50_o50(og: DataFrame) -> DataFrame:
    """Size of the orthogroups that, taken largest first, reach half of the
    genes, and how many of them are needed."""
    sizes = og.groupBy("orthogroup").agg(F.count(F.lit(1)).alias("size"))
    steps = cumulative_share(sizes, "size")
    half = F.col("total_members") / F.lit(2.0)
    reached = F.col("cum_members") >= half
    missing = half - (F.col("cum_members") - F.col("members"))
    needed = F.col("cum_groups") - F.col("groups") + F.ceil(missing / F.col("size"))
    return steps.where(reached).agg(F.max("size").alias("g50"), F.max_by(needed, "size").cast("bigint").alias("o50"))


def ortholog_multiplicity(pairs: DataFrame) -> DataFrame:
    """Genes of species a by the kind of their relation to species b.

    ``pairs`` has ``(species_a, gene_a, species_b, gene_b)``, each pair once and
    in one direction; both directions are reported. ``many_to_one`` counts single
    genes of a with several partners, ``one_to_many`` genes of a that share one
    partner.
    """
    names = ["species_a", "gene_a", "species_b", "gene_b"]
    # Both directions of a row are made where it is: the pairs, however they come about, are computed once.
    read = [F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names)]) for cols in (names, [*names[2:], *names[:2]])]
    both = pairs.select(F.explode(F.array(*read)).alias("p")).select("p.*")
    side = ["species_b", "gene_b", "species_a"]
    # No gene has more pairs than all that share its cell: few numbers say whether one is too much for a task.
    cell = both.groupBy(F.pmod(F.xxhash64(*side), F.lit(GENE_CELLS)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    if (cell.agg(F.max("n")).first()[0] or 0) <= MAX_GROUP_ROWS:
        # As in a join, nothing is equal to NULL.
        known = both.where(" and ".join(f"{c} is not null" for c in side))
        met = known.repartition(*side).distinct().withColumn("n_back", F.count(F.lit(1)).over(Window.partitionBy(*side)))
    else:
        both = both.distinct()
        met = both.join(both.groupBy(*side).agg(F.count(F.lit(1)).alias("n_back")), side)
    per_gene = met.groupBy("species_a", "species_b", "gene_a").agg(F.count(F.lit(1)).alias("n_out"), F.max("n_back").alias("n_back"))
    several, shared = F.col("n_out") > 1, F.col("n_back") > 1
    return per_gene.groupBy("species_a", "species_b").agg(
        F.count_if(~several & ~shared).alias("one_to_one"),
        F.count_if(~several & shared).alias("one_to_many"),
        F.count_if(several & ~shared).alias("many_to_one"),
        F.count_if(several & shared).alias("many_to_many"),
        F.count(F.lit(1)).alias("total"),
    )


def duplication_counts(events: DataFrame) -> DataFrame:
    """Duplications per orthogroup and per species-tree node, long form."""
    each = events.select(
        F.explode(
            F.array(
                F.struct(F.lit("orthogroup").alias("level"), F.col("orthogroup").cast("string").alias("name")),
                F.struct(F.lit("node").alias("level"), F.col("node").cast("string").alias("name")),
            )
        ).alias("e")
    )
    return each.groupBy("e.level", "e.name").agg(F.count(F.lit(1)).alias("n_duplications"))
