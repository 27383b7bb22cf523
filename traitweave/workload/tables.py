"""Objects of the domain derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name prefixes given to features by id.
PREFIXES = ["go", "tpm", "pfa", "ppi", "pep", "zzz"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """For comparison only: floating sums depend on their order."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def feature_name(number: str | Column) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (number % len(PREFIXES) + 1).cast("int"))
    return F.concat_ws("_", prefix, number.cast("string"))


def feature_name_sql(number: str) -> str:
    return f"(list_element({PREFIXES!r}, CAST({number} % {len(PREFIXES)} + 1 AS INTEGER)) || '_' || {number})"


def importances(spark: SparkSession, sf: str) -> DataFrame:
    """Feature x target matrix ``(f1, f2, v)``; both axes share one name space."""
    n = table(spark, sf, "supplier").count()
    items = table(spark, sf, "lineitem")
    value = F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0))
    cells = items.groupBy((F.col("l_partkey") % n).alias("f"), F.col("l_suppkey").alias("t")).agg(value.alias("v"))
    return cells.select(feature_name("f").alias("f1"), feature_name("t").alias("f2"), "v")


IMPORTANCES = f"""
imp AS (
  SELECT {feature_name_sql('f')} AS f1, {feature_name_sql('t')} AS f2, v FROM (
    SELECT l_partkey % (SELECT count(*) FROM supplier) AS f, l_suppkey AS t,
           sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS v
    FROM lineitem GROUP BY 1, 2)
)"""

RANKS = (
    IMPORTANCES
    + """,
ranks AS (
  SELECT f1, f2, v,
         rank() OVER (PARTITION BY f2 ORDER BY v DESC)
           + (count(*) OVER (PARTITION BY f2, v) - 1) / 2.0::DOUBLE AS rank
  FROM imp WHERE v <> 0
)"""
)

# The flagship table: mutual ranks of importances without zeros.
PAIRS = (
    RANKS
    + """,
pairs AS (
  SELECT least(f1, f2) AS f1, greatest(f1, f2) AS f2, sqrt(min(rank)::DOUBLE * max(rank)::DOUBLE) AS MR
  FROM (SELECT f1 AS a, f2 AS b, f1, f2, rank FROM ranks) WHERE f1 <> f2
  GROUP BY least(f1, f2), greatest(f1, f2) HAVING count(*) = 2
)"""
)

# Fixed values of the domain, as in functions/columns.py.
FAMILY_SQL = """
CASE WHEN split_part({c}, '_', 1) = 'go' THEN 'GO'
     WHEN split_part({c}, '_', 1) IN ('spm','tpm','dge','dia','dit') THEN 'Expression'
     WHEN split_part({c}, '_', 1) IN ('mob','pfa','tmh','num') THEN 'Protein Domain'
     WHEN split_part({c}, '_', 1) IN ('ppi','pid','coe','cid','ttr','tti','ttf','agn','agi') THEN 'Networks'
     WHEN split_part({c}, '_', 1) IN ('ort','phy','sin','tan','pep','cin','cif','gwa','twa','hom','ntd','gbm','con','ptm') THEN 'Others'
     ELSE {c} END"""


def family_sql(col: str) -> str:
    return FAMILY_SQL.format(c=col)


def hash_sql(seed, *cols: str) -> str:
    """md5 order in SQL."""
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def hash_int_sql(seed, *cols: str) -> str:
    return f"CAST('0x' || substr({hash_sql(seed, *cols)}, 1, 13) AS BIGINT)"


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with a rare class: one market segment against the others."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        (F.col("c_mktsegment") == "MACHINERY").cast("int").alias("y"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )


PEOPLE = """
people AS (
  SELECT c_custkey AS key, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS y,
         c_nationkey AS nation, c_acctbal AS balance
  FROM customer
)"""


def orthogroup_genes(spark: SparkSession, sf: str) -> DataFrame:
    """``(orthogroup, species, gene)``: lines of an order by region of the supplier."""
    items = table(spark, sf, "lineitem")
    place = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    gene = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return items.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("orthogroup"), F.col("r_name").alias("species"), gene.alias("gene")
    )


ORTHOGROUPS = """
og AS (
  SELECT l_orderkey AS orthogroup, r_name AS species,
         concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS gene
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def documents_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Wide matrix of labelled documents: key, label, continuous and 0/1 columns."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    text = F.col("text")
    words = F.size(F.split(text, r"\s+"))
    langs = ["en", "fr", "de", "es"]
    return docs.select(
        F.col("doc_id").alias("key"),
        F.col("toxic").cast("double").alias("label"),
        F.col("n_chars").cast("double").alias("pep_chars"),
        words.cast("double").alias("pep_words"),
        (F.col("n_chars") / words).alias("pep_mean"),
        F.size(F.split(text, "\n")).cast("double").alias("pep_lines"),
        *[(F.col("lang") == lang).cast("int").alias(f"ort_{lang}") for lang in langs],
        F.col("quality").alias("ort_quality"),
        text.rlike("[0-9]").cast("int").alias("ort_digits"),
    )


CONTINUOUS = ["pep_chars", "pep_words", "pep_mean", "pep_lines"]
CATEGORICAL = ["ort_en", "ort_fr", "ort_de", "ort_es", "ort_quality", "ort_digits"]
