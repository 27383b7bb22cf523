"""Projection, filtering and scalar reshaping of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import lookup_join
from ..plans.ordering import quantiles


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last``, both included."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def columns_of_type(df: DataFrame, type_name: str) -> list[str]:
    """Names of the columns whose simple type name is ``type_name``."""
    return [name for name, kind in df.dtypes if kind == type_name]


def where_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def split_at(df: DataFrame, col: str, t: float, label: str = "side") -> DataFrame:
    """Mark rows ``above`` (>= t) or ``below``; NULL counts as below."""
    return df.withColumn(label, F.when(F.coalesce(F.col(col) >= t, F.lit(False)), "above").otherwise("below"))


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.select(*cols).distinct() if cols else df.distinct()


def melt(
    df: DataFrame, key: str | Sequence[str], cols: Sequence[str] | None = None,
    feature: str = "feature", value: str = "value",
) -> DataFrame:
    """Wide to long; NULL cells give no row."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = list(cols) if cols else [c for c in df.columns if c not in keys]
    numeric = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return numeric.unpivot(keys, cols, feature, value).where(F.col(value).isNotNull())


def zero_to_null(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(0)))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(cols))


def fill_median(df: DataFrame, col: str) -> DataFrame:
    """Replace NULL by the exact median of the column."""
    middle = quantiles(df, [], col, {"middle": 0.5}).select("middle")
    return df.withColumn(col, F.coalesce(F.col(col), middle.scalar()))


def downcast(df: DataFrame, cont_cols: Sequence[str], cat_cols: Sequence[str]) -> DataFrame:
    """Continuous to FLOAT, categorical to TINYINT; an overflow fails (ANSI mode)."""
    narrow = {c: F.col(c).cast("float") for c in cont_cols}
    narrow |= {c: F.col(c).cast("tinyint") for c in cat_cols}
    return df.withColumns(narrow)


def feature_kinds(features: DataFrame, ftypes: DataFrame, label: str | None = None) -> DataFrame:
    """Kind (continuous, categorical) of each feature by its prefix.

    ``ftypes`` has the columns ``prefix`` (with its trailing ``_``) and ``kind``.
    Features with an unlisted prefix, and the label, are left out.
    """
    named = features.select("feature").distinct()
    if label is not None:
        named = named.where(F.col("feature") != label)
    named = named.withColumn("prefix", F.concat(C.prefix_of("feature"), F.lit("_")))
    return lookup_join(named, ftypes.select("prefix", "kind"), ["prefix"], "inner").select("feature", "kind")


def with_prefix(df: DataFrame, col: str, name: str = "prefix") -> DataFrame:
    return df.withColumn(name, C.prefix_of(col))


def with_family(df: DataFrame, col: str, families: dict | None = None, name: str = "family") -> DataFrame:
    return df.withColumn(name, C.family_of(col, families))


def with_pair_family(df: DataFrame, c1: str, c2: str, families: dict | None = None, name: str = "pair") -> DataFrame:
    """One key per unordered pair of families."""
    return df.withColumn(name, C.pair_key(C.family_of(c1, families), C.family_of(c2, families)))


def explode_list(df: DataFrame, col: str, sep: str = " ") -> DataFrame:
    return df.withColumn(col, F.explode(F.split(F.col(col), F.concat(F.lit(r"\Q"), F.lit(sep), F.lit(r"\E")))))


def clean_ids(df: DataFrame, cols: Sequence[str], sep: str = ", ", field: int = 1) -> DataFrame:
    return df.withColumns({c: C.cleaned_ids(c, sep, field) for c in cols})


def transcript_to_gene(df: DataFrame, col: str, on_many: str = "error") -> DataFrame:
    """Replace transcript ids by gene ids.

    ``error`` fails when a transcript is repeated or two transcripts share a
    gene; ``max`` keeps the largest value of every other column per gene.
    """
    named = df.withColumn(col, C.gene_of(col))
    others = [c for c in df.columns if c != col]
    merged = named.groupBy(col).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in others])
    if on_many == "error":
        many = F.raise_error(F.concat(F.lit("several transcripts of "), F.col(col))).cast("string")
        merged = merged.withColumn(col, F.when(F.col("_n") > 1, many).otherwise(F.col(col)))
    elif on_many != "max":
        raise ValueError(f"on_many: {on_many}")
    return merged.select(*df.columns)


def regulation_flags(df: DataFrame, qval: str = "qval", b: str = "b", alpha: float = 0.05) -> DataFrame:
    return df.withColumns({"up": C.regulated(qval, b, True, alpha), "down": C.regulated(qval, b, False, alpha)})


def accession_path(df: DataFrame, col: str) -> DataFrame:
    path, status = C.archive_path(col)
    return df.withColumns({"path": path, "status": status})


def with_run_path(df: DataFrame, col: str, root: str = "./kal_output") -> DataFrame:
    return df.withColumn("path", F.concat(F.lit(root + "/"), F.col(col), F.lit("_kal_out")))


def rename_features(
    df: DataFrame, prefix: str = "", replace: dict[str, str] | None = None, col: str = "feature"
) -> DataFrame:
    """Rename the features of a long matrix: replacements, then a prefix."""
    name = F.col(col)
    for old, new in (replace or {}).items():
        name = F.replace(name, F.lit(old), F.lit(new))
    return df.withColumn(col, F.concat(F.lit(prefix), name))


def encode_minority(df: DataFrame, label: str, name: str = "y") -> DataFrame:
    """1 for the rarest label, 0 for the commonest; equal counts go by label order."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", label)
    ends = counts.agg(F.struct(F.min_by(label, order).alias("rare"), F.max_by(label, order).alias("common"))).scalar()
    return df.withColumn(name, F.when(F.col(label) == ends["rare"], 1).when(F.col(label) == ends["common"], 0))


def with_duration(df: DataFrame, start: str, end: str, name: str = "seconds") -> DataFrame:
    """Seconds between two ``dd/MM/yyyy HH:mm:ss`` texts."""
    at = [F.unix_timestamp(F.to_timestamp(c, C.LOG_TIME)) for c in (start, end)]
    return df.withColumn(name, at[1] - at[0])
