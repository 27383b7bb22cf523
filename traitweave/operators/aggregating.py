"""Counts, proportions, histograms, summaries and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.joins import lookup_join, null_safe_join
from ..plans.ordering import quantiles
from ..session import checkpointed


def annotation_counts(ann: DataFrame) -> DataFrame:
    """Domain counts per protein from ``(protein, analysis, signature)``.

    A protein without hits of an analysis has NULL there, as after an outer
    alignment. Equal hits are counted first, so one protein with most of the
    hits shuffles only its distinct ones.
    """
    hits = (
        ann.where(F.col("analysis").isin("Pfam", "MobiDBLite", "TMHMM"))
        .groupBy("protein", "analysis", "signature")
        .agg(F.count("signature").alias("n"))
    )

    def total(analysis: str):
        return F.sum(F.when(F.col("analysis") == analysis, F.col("n")))

    known = (F.col("analysis") == "Pfam") & F.col("signature").isNotNull()
    return hits.groupBy("protein").agg(
        total("Pfam").alias("num_counts"),
        F.sum(F.when(F.col("analysis") == "Pfam", known.cast("bigint"))).alias("num_u_counts"),
        total("MobiDBLite").alias("mob_counts"),
        total("TMHMM").alias("tmh_counts"),
    )


def category_proportions(pairs: DataFrame, group_col: str = "side") -> DataFrame:
    """Share of each prefix among both pair ends, above and below, and the difference."""
    ends = pairs.select(group_col, F.explode(F.array("f1", "f2")).alias("feature"))
    counts = ends.groupBy(C.prefix_of("feature").alias("feature_cat")).agg(
        F.count_if(F.col(group_col) == "above").alias("n_above"),
        F.count_if(F.col(group_col) == "below").alias("n_below"),
    )
    totals = counts.agg(F.struct(F.sum("n_above").alias("a"), F.sum("n_below").alias("b")).alias("t")).scalar()
    above, below = totals["a"], totals["b"]
    shares = counts.select(
        "feature_cat", "n_above", "n_below",
        (F.nullif(F.col("n_above"), F.lit(0)) / above).alias("above_thresh"),
        (F.nullif(F.col("n_below"), F.lit(0)) / below).alias("below_thresh"),
    )
    return shares.withColumn("prop_diff", F.col("above_thresh") - F.col("below_thresh"))


def indicator(df: DataFrame, key: str, term: str, distinct: bool = False, prefix: str = "") -> DataFrame:
    """One-hot in long form: ``(key, feature, value)``, value = number of rows.

    Absent cells are zero and take no space; ``distinct`` counts a pair once.
    """
    pairs = df.select(F.col(key).alias("key"), F.concat(F.lit(prefix), F.col(term).cast("string")).alias("feature"))
    counts = pairs.groupBy("key", "feature").agg(F.count(F.lit(1)).alias("value"))
    return counts.withColumn("value", F.lit(1).cast("bigint")) if distinct else counts


def widen(long: DataFrame, features: Sequence[str], fill=0) -> DataFrame:
    """Long to wide for a given, small list of features."""
    return long.groupBy("key").pivot("feature", list(features)).agg(F.sum("value")).na.fill(fill)


def drop_singletons(long: DataFrame) -> DataFrame:
    """Remove features that are non-zero for exactly one key."""
    held = long.groupBy("feature").agg(F.count_if(F.col("value") != 0).alias("n"))
    return long.join(held.where("n = 1"), "feature", "left_anti").select(*long.columns)


def join_strings(df: DataFrame, key: str, col: str, sep: str = " ") -> DataFrame:
    """The distinct values of each key in one cell, in text order.

    The cell is the result, so a key whose values exceed the 2 GB of a cell
    cannot be written this way; ``indicator`` keeps the same facts as rows.
    """
    once = df.select(key, col).distinct()
    return once.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(col)), sep).alias(col))


def bounds(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("n"))


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows, NULLs, zeros, ones and the share of zeros among values."""
    # One aggregate row, turned into one row per column afterwards.
    profiles = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.count_if(F.col(c) == 0).alias("n_zero"),
            F.count_if(F.col(c) == 1).alias("n_one"),
            F.avg((F.col(c) == 0).cast("double")).alias("sparsity"),
        )
        for c in cols
    ]
    return df.agg(F.array(*profiles).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed, empty ones included.

    A column with one value gets the range half a unit to both sides.
    """
    keys = [by] if by else []
    # The values are written once: the range and the bins both read them, and neither shuffles them.
    values = checkpointed(df.where(F.col(col).isNotNull()).select(*keys, col))
    ends = values.groupBy(*keys).agg(
        F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"), F.count(F.lit(1)).alias("n")
    ).where("n > 0")
    flat = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = ends.select(*keys, (F.col("lo") - flat).alias("lo"), (F.col("hi") + flat).alias("hi"))
    if by:
        placed = lookup_join(values, ends, keys, "inner")
    else:
        placed = values.withColumn("_ends", ends.select(F.struct("lo", "hi")).scalar()).select("*", "_ends.*")
    place = F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counted = placed.groupBy(*keys, F.least(place + 1, F.lit(bins)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    frame = ends.where(F.col("lo").isNotNull()).select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    full = null_safe_join(frame, counted, [*keys, "bin"], "left")
    return full.select(
        *keys, "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("lower"),
        (F.col("lo") + width * F.col("bin")).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_summary(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outlier count."""
    keys = [by] if by else []
    values = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    boxes = quantiles(values, keys, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, weight="_n")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    if by:
        placed = null_safe_join(values, boxes, keys)
    else:
        box = boxes.select(F.struct("n", "q1", "median", "q3")).scalar()
        placed = values.withColumn("_box", box).select("*", "_box.*")
    inside = (F.col(col) >= F.col("q1") - reach) & (F.col(col) <= F.col("q3") + reach)
    return placed.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3")],
        F.min(F.when(inside, F.col(col))).alias("whisker_low"),
        F.max(F.when(inside, F.col(col))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"),
    )


def mean_importance(long_runs: DataFrame) -> DataFrame:
    """Importance of each feature averaged over repeated runs, largest first."""
    means = long_runs.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return means.orderBy(F.col("importance").desc(), "feature")


def fold_summary(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))


def integrity_report(
    df: DataFrame,
    unique: Sequence[str] = (),
    not_null: Sequence[str] = (),
    allowed: dict[str, Sequence] | None = None,
    positive: Sequence[str] = (),
) -> DataFrame:
    """One row per rule: ``(rule, n_bad, ok)``."""
    checks = {f"not null {c}": F.count_if(F.col(c).isNull()) for c in not_null}
    for c, values in (allowed or {}).items():
        checks[f"allowed {c}"] = F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values))
    for c in positive:
        checks[f"positive {c}"] = F.count_if(~F.coalesce(F.col(c) >= 1, F.lit(False)))
    rows = []
    if checks:
        row = df.agg(*[c.alias(f"r{i}") for i, c in enumerate(checks.values())])
        named = row.withColumnsRenamed({f"r{i}": n for i, n in enumerate(checks)})
        rows.append(named.unpivot([], list(checks), "rule", "n_bad"))
    for c in unique:
        repeats = df.groupBy(c).agg((F.count(F.lit(1)) - 1).alias("n"))
        rows.append(repeats.agg(F.lit(f"unique {c}").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_bad")))
    report = rows[0]
    for extra in rows[1:]:
        report = report.unionByName(extra)
    return report.withColumn("ok", F.col("n_bad") == 0)


def fastq_layout(manifest: DataFrame) -> DataFrame:
    """Layout of each run from its file names ``(run, file, n_processed)``."""

    def has(suffix: str):
        return F.coalesce(F.bool_or(F.col("file") == F.concat("run", F.lit(suffix))), F.lit(False))

    runs = manifest.groupBy("run").agg(
        has(".fastq.gz").alias("single"),
        has("_1.fastq.gz").alias("mate1"),
        has("_2.fastq.gz").alias("mate2"),
        F.max("n_processed").alias("n_processed"),
    )
    single, mate1, mate2 = F.col("single"), F.col("mate1"), F.col("mate2")
    layout = (
        F.when(single & ~mate1 & ~mate2, "single")
        .when(single & mate1 & mate2, "three_files")
        .when(~single & mate1 & mate2, "paired")
        .otherwise("fail")
    )
    return runs.select(
        "run", layout.alias("layout"),
        (layout != "fail").alias("passes"),
        F.coalesce(F.col("n_processed") == 0, F.lit(False)).alias("zero_reads"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
