"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lookups against a unique key are the only joins whose big side may have a
    # hot key; AQE splits such a partition at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Training fan-out submits jobs from several driver threads.
    "spark.scheduler.mode": "FAIR",
}


def build_session(app: str = "traitweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder is made only in local mode, where driver and executors
    are one machine.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        known = tempfile.mkdtemp(prefix="traitweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when this Python process ends.

    Results may read it until then, so nothing goes earlier.
    """
    folder = f"{shared_dir(spark)}/traitweave-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


@atexit.register
def _sweep() -> None:
    """Delete the scratch folders, through Spark's own file systems; without a JVM there is nothing to reach them by."""
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    for folder in _made if jvm is not None else ():
        with contextlib.suppress(Exception):
            conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends and it is computed once.

    (``DataFrame.checkpoint`` computes a table twice.) Like all scratch tables it
    is deleted when this process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
