"""Studies of many runs that can be stopped and continued.

The work items of a study are a table. Each item's rows go to a folder of their
own, and a line in the ledger says that they are complete; an item without a line
is done (again). Nothing is held back for a common plan, so a study of thousands
of runs plans as fast as one of two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def item_id(item: dict) -> str:
    """The same item has the same id in every run."""
    return hashlib.md5("|".join(f"{k}={item[k]!r}" for k in sorted(item)).encode()).hexdigest()[:20]


class Study:
    """Work items (dicts of plain values) under one path; ``scratch`` if none is given."""

    def __init__(self, spark: SparkSession, items: list[dict], path: str | None = None, parallelism: int = 1):
        self.spark, self.path, self.parallelism = spark, path or scratch(spark, "study"), parallelism
        self.items = {item_id(i): i for i in items}

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def finished(self) -> DataFrame:
        """The ledger: ``(item, started, ended)``."""
        schema = "item string, started timestamp, ended timestamp"
        if not self._exists("ledger"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/ledger")

    def pending(self) -> DataFrame:
        """``(item)`` without a line in the ledger, in the order they were given."""
        table = self.spark.createDataFrame([(i, k) for k, i in enumerate(self.items)], "item string, place int")
        return table.join(self.finished(), "item", "left_anti").orderBy("place").select("item")

    def run(self, work: Callable[[dict], DataFrame], limit: int | None = None) -> Study:
        """Do the pending items, or the first ``limit`` of them. ``work`` returns an item's rows; the item's values are put in front."""
        todo = [r["item"] for r in self.pending().collect()][:limit]

        def one(job: tuple[int, str]) -> None:
            slot, name = job
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"study{slot % self.parallelism}")
            started, item = datetime.now(), self.items[name]
            rows = work(item)
            rows.select(*[F.lit(v).alias(k) for k, v in item.items()], "*").write.mode("overwrite").parquet(f"{self.path}/rows/{name}")
            self.spark.createDataFrame([(name, started, datetime.now())], "item string, started timestamp, ended timestamp").write.mode("overwrite").parquet(
                f"{self.path}/ledger/{name}")

        if self.parallelism == 1:
            for job in enumerate(todo):
                one(job)
        else:
            with ThreadPoolExecutor(self.parallelism) as pool:
                list(pool.map(one, enumerate(todo)))
        return self

    def _folders(self) -> Iterator[str]:
        done = {r["item"] for r in self.finished().collect()}
        return (f"{self.path}/rows/{name}" for name in self.items if name in done)

    def results(self) -> DataFrame:
        """The rows of all finished items: one scan, however many there are."""
        folders = list(self._folders())
        if not folders:
            raise ValueError("no item of the study is finished")
        return self.spark.read.parquet(*folders)
