"""Lines that many documents share stay in one document only, with DataFrame functions alone.

1. Each line becomes a row of its key's 128-bit hash, its document and its place.
2. The rows are range partitioned by hash and sorted by hash, document (largest
   id first) and place, so that the first occurrence of a hash streams by before
   the others: a running rank counts its documents, the first one keeps it.
3. What is dropped goes back as a compressed bitmap per document: words of 64
   lines, of which only those with a dropped line are stored. The texts themselves
   are never sorted; at the end a document meets its bitmap.

A key with more than one line in ``HOT_SHARE`` of all is dealt to ``SALTS`` units
by document, which lie side by side in the range order; each unit is streamed on
its own, and the units of the at most ``HOT_SHARE`` hot keys are summed afterwards.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, prepare, stored

#: What is stripped from both ends of a line.
WHITE = " \t\n\x0b\x0c\r"
#: Units of documents that a hot key is dealt to.
SALTS = 4096
#: Leading bits of a hash that are counted in order to find hot keys.
_BUCKET_BITS = 20
_NO_ID = -(1 << 63)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, d, t)``: a row is known by its id (NULL is the smallest) and a hash of its text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumns({"d": F.coalesce("id", F.lit(_NO_ID)), "t": F.xxhash64("text")})


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """``(h, g, d, t, pos)`` of every line whose key is long enough."""
    # The whole text is lower-cased at once; A to Z only, so texts with other letters go by way of a table.
    ascii_only = F.octet_length("text") == F.length("text")
    low = F.when(ascii_only, F.lower("text")).otherwise(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    lines = rows.select("d", "t", F.posexplode(F.split(low, "\n", -1)).alias("pos", "line"))
    keys = lines.select("d", "t", "pos", F.btrim("line", F.lit(WHITE)).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "d", "t", "pos")


def _hot_keys(lines: DataFrame) -> DataFrame:
    """The at most ``HOT_SHARE`` keys ``(h, g)`` that hold more than one line in ``HOT_SHARE``.

    Buckets of hashes are counted first, so that only the keys of full buckets
    are counted one by one.
    """
    total = lines.count()

    def often(rows: DataFrame, *by) -> DataFrame:
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * HOT_SHARE > F.lit(total)).drop("c")

    cut = F.shiftright("h", 64 - _BUCKET_BITS).alias("bucket")
    full = often(lines.select(cut), "bucket")
    return stored(often(lines.select("h", "g", cut).join(F.broadcast(full), "bucket"), "h", "g"), "hot_lines")


def _streamed(lines: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    """Lines that are dropped, and all lines of hot keys with the counts of their unit.

    ``n`` documents of the unit hold the key; ``keeper`` is the largest of them.
    """
    marked = lines.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["h", "g"], "left")
    marked = marked.withColumn("hot", F.coalesce("hot", F.lit(False)))
    marked = marked.withColumn("s", F.when(F.col("hot"), F.pmod("t", F.lit(SALTS)).cast("int")).otherwise(0))
    by = ["h", "g", "s"]
    placed = marked.repartitionByRange(*by).sortWithinPartitions(*by, F.desc("d"), "t", "pos")
    unit = Window.partitionBy(*by)
    seen = placed.withColumn("rank", F.dense_rank().over(unit.orderBy(F.desc("d"), "t")))
    seen = seen.withColumns({"n": F.max("rank").over(unit).cast("bigint"), "keeper": F.max("d").over(unit)})
    return seen.where(F.col("hot") | _gone(min_docs))


def _gone(min_docs: int) -> Column:
    return (F.col("n") >= min_docs) & (F.col("d") < F.col("keeper"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(d, t, keep)`` of the documents that lose a line.

    ``keep`` is an array of ``(word, bits)`` in order: bit ``i`` of word ``w``
    says that line ``64 w + i`` stays. All lines of absent words stay.
    """
    prepare(docs.sparkSession)
    lines = stored(_lines(_documents(docs, id_col, text_col), min_chars), "lines")
    hot = _hot_keys(lines)
    seen = stored(_streamed(lines, hot, min_docs), "streamed")
    # Each document of a hot key is in one unit, so units add up. A unit's keeper has rank 1.
    units = seen.where("hot").groupBy("h", "g", "s").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"))
    whole = stored(units.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")), "hot_sums")
    often = seen.where("hot").drop("n", "keeper").join(F.broadcast(whole), ["h", "g"]).where(_gone(min_docs))
    gone = seen.where("not hot").select("d", "t", "pos").unionByName(often.select("d", "t", "pos"))
    words = gone.select("d", "t", F.expr("pos div 64").cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = words.groupBy("d", "t", "word").agg(F.bitwise_not(F.bit_or("bit")).alias("bits"))
    return words.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _flat(keep: Column) -> Column:
    """The words from the first to the last stored one as an array of BIGINT."""

    def with_gap(e: Column, i: Column) -> Column:
        before = F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(-1).cast("bigint"), e["word"] - before - 1), F.array(e["bits"]))

    return F.flatten(F.transform(keep, with_gap))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(id, n_lines, n_dropped, keep, kept_text)`` per row of ``docs``.

    A text is split at line feeds; NULL and empty texts have one empty line. A
    line's key is the line without white space at both ends and with A to Z in
    lower case. Keys of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold lose all lines but those of the document with the
    largest id; of several documents with that id all keep theirs. A NULL id is
    smaller than every other. Rows that agree in id and text are one document and
    all get its result. ``keep`` is NULL where nothing is dropped.
    """
    rows = _documents(docs, id_col, text_col)
    maps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs).withColumn("flat", _flat(F.col("keep")))
    met = rows.join(maps, ["d", "t"], "left")
    stays = functools.partial(F.filter, F.split("text", "\n", -1))
    kept = F.array_join(stays(lambda _, i: F.coalesce(F.getbit(F.get("flat", F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1), "\n")
    dropped = F.aggregate("keep", F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(F.bitwise_not(w["bits"])))
    return met.select(
        "id",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).alias("n_dropped"),
        "keep",
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
