"""Time the large operators on generated matrices of the published sizes.

    python scale_bench.py 1000000 10000000 112497861

Nothing here is a registered query; the inputs only have the published shape.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from traitweave.operators import aggregating as A
from traitweave.operators import ranking as R
from traitweave.session import build_session


def importance_cells(spark, n_cells: int):
    """A square matrix in which 98.96 % of the cells are zero."""
    side = int(n_cells**0.5)
    ids = spark.range(side * side, numPartitions=64)
    mix = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    return ids.select(
        (F.col("id") % side).cast("int").alias("f1"),
        F.floor(F.col("id") / side).cast("int").alias("f2"),
        F.when(mix < 10_400, mix / 1e6).otherwise(0.0).alias("v"),
    )


def term_rows(spark, genes: int, terms: int, per_gene: int):
    ids = spark.range(genes * per_gene, numPartitions=64)
    term = F.pmod(F.xxhash64("id"), F.lit(terms))
    return ids.select((F.col("id") % genes).alias("gene"), term.alias("term"))


def timed(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 2)


def main(sizes: list[int]) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "traitweave-scale", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": "64", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "20g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for n in sizes:
        cells = importance_cells(spark, n)
        start = time.perf_counter()
        ranked = R.rank_desc_average(cells, "f2", "v")
        took = timed(R.mutual_rank(ranked))
        print(json.dumps({"mutual_rank_all_cells": n, "sec": round(time.perf_counter() - start, 2), "run": took}), flush=True)
        start = time.perf_counter()
        timed(R.mutual_rank_nonzero(cells))
        print(json.dumps({"mutual_rank_nonzero": n, "sec": round(time.perf_counter() - start, 2)}), flush=True)
        start = time.perf_counter()
        timed(A.histogram(R.geometric_mean_importance(cells), "GFI", 16))
        print(json.dumps({"geometric_mean_and_histogram": n, "sec": round(time.perf_counter() - start, 2)}), flush=True)
    rows = term_rows(spark, 31302, 5709, 60)
    took = timed(A.drop_singletons(A.indicator(rows, "gene", "term", prefix="go_")))
    print(json.dumps({"indicator_and_singletons": "31302 x 5709", "sec": took}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main([int(a) for a in sys.argv[1:]] or [1_000_000])
