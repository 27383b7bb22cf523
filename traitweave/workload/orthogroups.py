"""Orthogroup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orthogroups as O
from ..operators.ranking import cumulative_share
from .tables import ORTHOGROUPS, orthogroup_genes, rounded, table

SPECIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _regions(spark, sf):
    """Column names come from the table: one per species, sorted."""
    return sorted(r[0] for r in table(spark, sf, "region").select("r_name").collect())


def _wide(spark, sf):
    return O.gene_counts(orthogroup_genes(spark, sf), _regions(spark, sf))


def _multi(spark, sf):
    pairs = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderpriority").alias("species_a"), F.col("l_orderkey").cast("string").alias("gene_a"),
            F.col("p_type").alias("species_b"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("gene_b"),
        )
    )
    return O.ortholog_multiplicity(pairs)


def _events(spark, sf):
    return orthogroup_genes(spark, sf).select("orthogroup", F.col("species").alias("node"))


def _sizes(spark, sf):
    return orthogroup_genes(spark, sf).groupBy("orthogroup").agg(F.count(F.lit(1)).alias("size"))


STATS_SQL = f"""WITH {ORTHOGROUPS},
cells AS (SELECT orthogroup, species, count(*) AS n FROM og GROUP BY 1, 2),
size AS (SELECT orthogroup, sum(n) AS size, count(*) AS k FROM cells GROUP BY 1),
j AS (SELECT * FROM cells JOIN size USING (orthogroup) WHERE size > 1),
a AS (SELECT species, grouping(species) AS g, sum(n) AS n_assigned, count(DISTINCT orthogroup) AS n_orthogroups,
        count(DISTINCT CASE WHEN k = 1 THEN orthogroup END) AS n_specific,
        sum(CASE WHEN k = 1 THEN n ELSE 0 END) AS n_genes_specific
      FROM j GROUP BY GROUPING SETS ((species), ())),
t AS (SELECT species, grouping(species) AS g, count(*) AS n_genes FROM og GROUP BY GROUPING SETS ((species), ()))
SELECT t.species, CAST(n_genes AS BIGINT) AS n_genes, CAST(coalesce(n_assigned, 0) AS BIGINT) AS n_assigned,
       CAST(coalesce(n_orthogroups, 0) AS BIGINT) AS n_orthogroups, CAST(coalesce(n_specific, 0) AS BIGINT) AS n_specific,
       CAST(coalesce(n_genes_specific, 0) AS BIGINT) AS n_genes_specific,
       CAST(n_genes - coalesce(n_assigned, 0) AS BIGINT) AS n_unassigned,
       round(coalesce(n_assigned, 0)::DOUBLE / n_genes, 6) AS share_assigned
FROM t LEFT JOIN a ON t.g = a.g AND t.species IS NOT DISTINCT FROM a.species"""

MULTI_SQL = """WITH p AS (
  SELECT DISTINCT o_orderpriority AS sa, CAST(l_orderkey AS VARCHAR) AS ga, p_type AS sb, concat_ws('-', l_partkey, l_suppkey) AS gb
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
both_ways AS (SELECT * FROM p UNION ALL SELECT sb, gb, sa, ga FROM p),
back AS (SELECT sb, gb, sa, count(*) AS nb FROM both_ways GROUP BY ALL),
g AS (SELECT b.sa, b.sb, b.ga, count(*) AS n_out, max(nb) AS n_back
      FROM both_ways b JOIN back USING (sb, gb, sa) GROUP BY 1, 2, 3)
SELECT sa AS species_a, sb AS species_b, count(*) FILTER (n_out = 1 AND n_back = 1) AS one_to_one,
       count(*) FILTER (n_out = 1 AND n_back > 1) AS one_to_many, count(*) FILTER (n_out > 1 AND n_back = 1) AS many_to_one,
       count(*) FILTER (n_out > 1 AND n_back > 1) AS many_to_many, count(*) AS total
FROM g GROUP BY 1, 2"""

QUERIES = {
    "orthogroup_gene_counts": (
        _wide,
        f"""WITH {ORTHOGROUPS} SELECT orthogroup, """
        + ", ".join(f"count(*) FILTER (species = '{s}') AS \"{s}\"" for s in SPECIES)
        + " FROM og GROUP BY 1",
    ),
    "single_copy_orthogroups": (
        lambda spark, sf: O.single_copy(orthogroup_genes(spark, sf)),
        f"""WITH {ORTHOGROUPS} SELECT orthogroup FROM og GROUP BY 1
        HAVING count(*) = count(DISTINCT species) AND count(*) = (SELECT count(DISTINCT species) FROM og)""",
    ),
    "unassigned_genes": (
        lambda spark, sf: O.unassigned(orthogroup_genes(spark, sf).select("species", "gene"), orthogroup_genes(spark, sf)),
        f"""WITH {ORTHOGROUPS} SELECT species, gene FROM og WHERE gene NOT IN (
          SELECT gene FROM og WHERE orthogroup IN (SELECT orthogroup FROM og GROUP BY 1 HAVING count(*) > 1))""",
    ),
    "species_overlap": (
        lambda spark, sf: O.species_overlap(orthogroup_genes(spark, sf)),
        f"""WITH {ORTHOGROUPS}, d AS (SELECT DISTINCT orthogroup, species FROM og)
        SELECT a.species AS species_a, b.species AS species_b, count(*) AS n_orthogroups
        FROM d a JOIN d b USING (orthogroup) GROUP BY 1, 2""",
    ),
    "orthogroup_statistics": (
        lambda spark, sf: rounded(
            O.og_statistics(orthogroup_genes(spark, sf), orthogroup_genes(spark, sf).select("species", "gene")), "share_assigned"
        ),
        STATS_SQL,
    ),
    "g50_o50": (
        lambda spark, sf: O.g50_o50(orthogroup_genes(spark, sf)),
        f"""WITH {ORTHOGROUPS}, s AS (SELECT orthogroup, count(*) AS size FROM og GROUP BY 1),
        c AS (SELECT size, row_number() OVER w AS i, sum(size) OVER w AS cum, (SELECT count(*) FROM og) AS total FROM s
              WINDOW w AS (ORDER BY size DESC, orthogroup ROWS UNBOUNDED PRECEDING))
        SELECT max(size) AS g50, CAST(min(i) AS BIGINT) AS o50 FROM c WHERE cum >= total / 2.0""",
    ),
    "ortholog_multiplicity": (_multi, MULTI_SQL),
    "duplication_counts": (
        lambda spark, sf: O.duplication_counts(_events(spark, sf)),
        f"""WITH {ORTHOGROUPS} SELECT 'orthogroup' AS level, CAST(orthogroup AS VARCHAR) AS name, count(*) AS n_duplications FROM og GROUP BY 2
        UNION ALL SELECT 'node', species, count(*) FROM og GROUP BY 2""",
    ),
    "cumulative_share": (
        lambda spark, sf: rounded(cumulative_share(_sizes(spark, sf), "size"), "share"),
        f"""WITH {ORTHOGROUPS}, s AS (SELECT orthogroup, count(*) AS size FROM og GROUP BY 1),
        d AS (SELECT size, count(*) AS groups, sum(size) AS members FROM s GROUP BY 1)
        SELECT size, groups, CAST(members AS BIGINT) AS members,
               CAST(sum(groups) OVER (ORDER BY size DESC) AS BIGINT) AS cum_groups,
               CAST(sum(members) OVER (ORDER BY size DESC) AS BIGINT) AS cum_members,
               CAST(sum(members) OVER () AS BIGINT) AS total_members,
               round(sum(members) OVER (ORDER BY size DESC) / sum(members) OVER (), 6) AS share FROM d""",
    ),
}
