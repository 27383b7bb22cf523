"""Text tables, run manifests and edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a header-less protein annotation file.
ANNOTATION = """
    protein STRING, md5 STRING, length INT, analysis STRING, signature STRING,
    description STRING, start INT, stop INT, score STRING, status STRING, date STRING,
    interpro STRING, interpro_description STRING, go STRING, pathways STRING
"""


def read_tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Tab-separated with a header; ``NA`` and empty cells are NULL."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="NA")


def read_feature_matrix(spark: SparkSession, path: str, ftypes: dict[str, str]) -> DataFrame:
    """Read only the header line first, then the matrix with narrow types.

    ``ftypes`` maps a prefix with its trailing ``_`` to ``continuous`` (FLOAT)
    or ``categorical`` (TINYINT); other columns become DOUBLE, the first column
    is the key.
    """
    names = spark.read.text(path).first()[0].split("\t")
    kinds = {"continuous": T.FloatType(), "categorical": T.ByteType()}
    fields = [T.StructField(names[0], T.StringType())]
    for name in names[1:]:
        kind = ftypes.get(name.split("_", 1)[0] + "_")
        fields.append(T.StructField(name, kinds.get(kind, T.DoubleType())))
    return read_tsv(spark, path, T.StructType(fields))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=False, schema=ANNOTATION)


def read_targets(spark: SparkSession, path: str, col: int = 0) -> DataFrame:
    """One column of a tab-separated list whose quote character is ``|``."""
    schema = ", ".join(f"_c{i} STRING" for i in range(col + 1))
    rows = spark.read.csv(path, sep="\t", quote="|", header=False, schema=schema)
    return rows.select(F.col(f"_c{col}").alias("target"))


def read_labelled_dir(spark: SparkSession, path: str, schema, pattern: str, of: str = "file_name") -> DataFrame:
    """All tables of a folder, labelled by a group of ``pattern`` on the file name, or on the whole path with ``of="file_path"``."""
    rows = read_tsv(spark, path, schema)
    return rows.withColumn("label", F.regexp_extract(F.col(f"_metadata.{of}"), pattern, 1))


# label = text before ``_sm``; label = text between the first
# ``_`` and the last ``.``.
BEFORE_SM = "^(.*?)_sm"
AFTER_UNDERSCORE = r"^[^_]*_(.*)\.[^.]*$"


def read_run_info(spark: SparkSession, glob: str) -> DataFrame:
    """``(run, n_processed)`` from one JSON file per run folder.

    The run is the folder name before its first ``_``; the folder of outdated
    runs is skipped.
    """
    rows = spark.read.schema("n_processed BIGINT").json(glob, multiLine=True)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = rows.withColumn("folder", folder).where("folder <> 'outdated_kal'")
    return rows.select(F.substring_index("folder", "_", 1).alias("run"), "n_processed")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Weighted edge list, three tab-separated columns."""
    return spark.read.csv(path, sep="\t", header=False, schema="src STRING, dst STRING, w DOUBLE")


def write_tsv(df: DataFrame, path: str, na: str = "") -> None:
    df.write.csv(path, sep="\t", header=True, nullValue=na, mode="overwrite")
