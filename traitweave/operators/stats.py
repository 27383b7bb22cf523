"""Permutation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hashing import number_by_hash
from ..plans.joins import BROADCAST_ROWS
from ..session import checkpointed


def permutation_test(props: DataFrame, n: int = 10000, seed=42) -> DataFrame:
    """Share of rounds in which a shuffled difference exceeds the observed one.

    ``props`` has ``(feature_cat, above_thresh, below_thresh, prop_diff)``. Every
    round permutes both proportion columns independently. A missing difference
    never counts as exceeded.
    """
    placed = checkpointed(number_by_hash(props, [], ["feature_cat"], f"{seed}:place", "pos"))
    # Small tables need no buckets within a round.
    digits = 0 if placed.count() <= BROADCAST_ROWS else 3
    rounds = placed.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def mixed(col: str):
        rows = rounds.select("round", "feature_cat", F.col(col).alias(f"p_{col}"))
        ordered = number_by_hash(rows, ["round"], ["round", "feature_cat"], f"{seed}:{col}", "pos", digits=digits)
        return ordered.drop("feature_cat")

    observed = rounds.select("round", "pos", "feature_cat", "prop_diff")
    joined = observed.join(mixed("above_thresh"), ["round", "pos"]).join(mixed("below_thresh"), ["round", "pos"])
    exceeds = F.coalesce(F.col("prop_diff") < F.col("p_above_thresh") - F.col("p_below_thresh"), F.lit(False))
    p = joined.groupBy("feature_cat").agg(F.avg(exceeds.cast("double")).alias("p_value_higher"))
    return p.withColumn("one_minus_p_value_higher", 1 - F.col("p_value_higher"))
