"""What several operators share: bounded Arrow batches, written tables, joins that
survive hot keys, connected components and word hashing over Arrow buffers."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of one Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Bytes of text that are turned into words at a time.
SLICE_BYTES = 1 << 17
#: A key is hot when it holds more than one row in HOT_SHARE; there are at most HOT_SHARE hot keys.
HOT_SHARE = 1_000


def prepare(spark: SparkSession) -> None:
    """Settings of this session that the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """Within, shuffle files go when the job that made them ends: what is needed later is the written table."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends, a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stored``, bucketed by ``key`` into as many buckets as shuffles have partitions: a join on it moves only the other side."""
    spark = df.sparkSession
    buckets = spark.conf.get("spark.sql.shuffle.partitions")
    path, table = scratch(spark, name), f"{name}_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    with _tidy(spark):
        df.write.insertInto(table)
    read = spark.table(table)
    read.stored_at = path
    return read


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_uid(*cols: Column) -> Column:
    """A 64-bit key that is never NULL; rows that agree in ``cols`` share it and count as one row."""
    return F.xxhash64(*cols)


def with_groups(rows: DataFrame, key: str, aggregates: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the ``aggregates`` of their ``key`` group; no task gets a hot group.

    The groups are aggregated with a partial step before the shuffle and
    written. A group with more than one row in ``HOT_SHARE`` is one of at most
    ``HOT_SHARE`` groups, so the table of those is broadcast and their rows
    stay where they are. The other rows meet their group in a shuffled join.
    ``rows`` is read three times, so it should be a written table. NULL keys
    are not expected.
    """
    groups = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(a) for a, c in aggregates.items()]), name)
    total = groups.agg(F.sum("_n")).first()[0] or 0
    is_hot = F.col("_n") * HOT_SHARE > F.lit(total)
    hot = F.broadcast(groups.where(is_hot))
    cold_rows = rows.join(F.broadcast(groups.where(is_hot).select(key)), key, "left_anti")
    cold = cold_rows.join(groups.where(~is_hot), key)
    return rows.join(hot, key).unionByName(cold).drop("_n")


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for links ``(a, b)`` of BIGINT nodes; the smallest node names a component.

    Alternates two star steps: every node links its larger neighbours, then
    its smaller ones, to the smallest. The least neighbour of each node is an
    aggregate with a partial step that is written before it is joined, so that
    both sides of the join are plain shuffles and a hub can be split.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # The set of edges is compared by its size and an order-free sum of hashes.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled edges are stars: every node but the smallest has exactly one.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


# -- words over Arrow buffers ---------------------------------------------------

WHITE = bytes([0x20, *range(0x09, 0x0E)])


def byte_table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: does it belong to a word, and the byte that is hashed for it."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[ord("A"):ord("Z") + 1] += 32
    return inside, to


def text_slices(column: pa.Array):
    """``(first row, bytes, row offsets)`` for runs of rows of about SLICE_BYTES; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """``(starts, ends, row bounds)``: words of each row; row ``i`` has words ``bounds[i]`` to ``bounds[i + 1]``."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1]
    heads = heads[heads < n]
    first[heads] = word[heads]  # a word does not go on into the next row
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:]
    tails = tails[tails > 0] - 1
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 2**64, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The usual 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE)]).astype(np.uint64))
    return _POWERS


def hash_rows(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's whole word sequence."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        place = np.arange(len(words)) - np.repeat(bounds[:-1], n)
        out[full] = np.add.reduceat(words * _powers(int(n.max()))[place], bounds[full])
    return mix(out + n.astype(np.uint64))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = _powers(int(lengths.max()))
    bounds = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(bounds, lengths)
    at = place + np.repeat(starts, lengths)
    values = _BYTE[to[data[at]]] * powers[place]
    return mix(np.add.reduceat(values, bounds) + lengths.astype(np.uint64))


def hash_runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive words (also across rows: callers mask those)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = _BASE
    for k in range(length):
        out = out * factor + words[k:k + n]
    return mix(out)


def list_array(values, bounds, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds), pa.int32()), pa.array(values, kind))
