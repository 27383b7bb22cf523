"""Embedding whitening by a covariance weighted with multiplicities.

1. Vectors become whole numbers, ``x = floor(64 c) + 1 000 000``, and equal ones are
   one row with a count (*multiplicity*). A fit weight is that count, or one.
2. Sums per dimension are exact. The covariance is a weighted centred matrix
   product per batch of distinct vectors; the partial products are summed by Spark.
3. The eigenvectors of a matrix of dimensions by dimensions are the only thing that
   the driver computes. Each distinct vector is whitened once, where it lies.
4. Rows meet their vector again by a 128-bit digest: the few vectors that many rows
   share are broadcast, the other rows are shuffled with 24 bytes each.

A vector travels in its smallest form: one byte that names the width, then one to
eight bytes per dimension, so equal vectors have equal bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, prepare, stored

#: Scale and shift that turn an entry into a whole number.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues up to this share of the trace are rounding errors of zero.
LEAST_SHARE = 1e-13
_WIDTHS = [np.dtype(f"<i{b}") for b in (1, 2, 4, 8)]
#: |64 c| from here on has no place in a BIGINT.
_LARGEST = 2.0**62


def packed_vector(embedding: Column) -> Column:
    """The vector as whole numbers in their smallest form; NULL if it is NULL, empty or has an entry that is NULL, not finite or 2^56 or more."""

    @F.arrow_udf("binary")
    def packed(vectors: pa.Array) -> pa.Array:
        vectors = vectors.cast(pa.large_list(pa.float64()))
        out: list[bytes | None] = [None] * len(vectors)
        size = np.diff(vectors.offsets.to_numpy())
        flat = vectors.values.slice(vectors.offsets[0].as_py() if len(vectors) else 0, int(size.sum()))
        value = np.floor(flat.to_numpy(zero_copy_only=False) * SCALE)  # NULL is not a number here
        with np.errstate(invalid="ignore"):
            good = np.abs(value) < _LARGEST
        x = np.where(good, value, 0).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        for r in np.flatnonzero((size > 0) & vectors.is_valid().to_numpy(zero_copy_only=False)):
            a, b = at[r], at[r + 1]
            if good[a:b].all():
                v = x[a:b]
                least, most = v.min(), v.max()
                k = next(k for k, w in enumerate(_WIDTHS) if np.iinfo(w).min <= least and most <= np.iinfo(w).max)
                out[r] = bytes([k]) + v.astype(_WIDTHS[k]).tobytes()
        return pa.array(out, pa.binary())

    return packed(embedding)


def unpack(packs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, whole numbers without the shift)`` for the packs of each length and width."""
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(packs):
        kinds.setdefault((p[0], len(p)), []).append(i)
    for (k, n), places in kinds.items():
        data = np.frombuffer(b"".join(packs[i] for i in places), np.uint8).reshape(-1, n)[:, 1:]
        yield np.array(places), np.ascontiguousarray(data).view(_WIDTHS[k]).astype(np.int64)


@dataclass
class Whitening:
    """What the fit of the vectors of one length says."""

    n: int
    sums: list[int]  # of the whole numbers without the shift
    mean: np.ndarray
    vectors: np.ndarray  # a column per component
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum of ``(n x - S)^2`` over the dimensions; the shift cancels."""
        room = max((self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))) ** 2 * x.shape[1], 1)
        if room < 2**63:
            return [int(v) for v in ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)]
        far = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) for v in (far * far).sum(axis=1)]


def _weights(batch: pa.RecordBatch, weighted: bool) -> np.ndarray:
    n = batch.column("n").to_numpy()
    return n if weighted else np.ones_like(n)


def _sums(distinct: DataFrame, weighted: bool) -> dict[int, tuple[int, list[int]]]:
    """Weights and exact sums per dimension, by length. Halves of 32 bits are summed on their own, so no sum leaves 64 bits."""

    def summed(batches):
        for batch in batches:
            w = _weights(batch, weighted)
            rows = []
            for places, x in unpack(batch.column("x").to_pylist()):
                k = w[places]
                for i in range(x.shape[1]):
                    col = x[:, i]
                    high, low = col >> 32, col & 0xFFFFFFFF
                    rows.append((x.shape[1], i, int((high * k).sum()), int((low >> 16) @ k), int((low & 0xFFFF) @ k), int(k.sum())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["size", "i", "a", "b", "c", "n"])

    parts = distinct.select("x", "n").mapInArrow(summed, "size bigint, i bigint, a bigint, b bigint, c bigint, n bigint")
    total = parts.groupBy("size", "i").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "abcn"])
    found: dict[int, tuple[int, list[int]]] = {}
    for r in total.orderBy("size", "i").collect():
        found.setdefault(r["size"], (int(r["n"]), []))[1].append((int(r["a"]) << 32) + (int(r["b"]) << 16) + int(r["c"]))
    return found


def _gram(rows: DataFrame, vectors: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sums of weighted outer products by group: ``vectors`` gives ``(group, weights, centred vectors)`` of a batch.

    A task adds its batches up and hands on one row per group and entry of the
    matrix; Spark sums those.
    """

    def multiplied(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, w, c in vectors(batch):
                part = c.T @ (c * w[:, None])
                held[group] = held[group] + part if group in held else part
        for group, m in held.items():
            size = m.shape[0]
            at = np.arange(size * size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size * size, group)), pa.array(at // size), pa.array(at % size), pa.array(m.ravel())], names=["grp", "i", "j", "v"]
            )

    parts = rows.mapInArrow(multiplied, "grp bigint, i bigint, j bigint, v double")
    found: dict[int, np.ndarray] = {}
    total = parts.groupBy("grp", "i", "j").agg(F.sum("v").alias("v")).orderBy("grp", "i", "j").toArrow()
    group, value = total.column("grp").to_numpy(), total.column("v").to_numpy()
    for g in np.unique(group):
        m = value[group == g]
        found[int(g)] = m.reshape(int(round(len(m) ** 0.5)), -1)
    return found


def fit_whitening(distinct: DataFrame, components: int = COMPONENTS, weighted: bool = False) -> dict[int, Whitening]:
    """Fit on rows ``(x, n)`` of distinct packed vectors; one model per length of vector."""
    sums = _sums(distinct, weighted)
    means = {size: np.array([float(Fraction(s, n)) for s in each]) for size, (n, each) in sums.items()}

    def centred(batch):
        w = _weights(batch, weighted).astype(float)
        for places, x in unpack(batch.column("x").to_pylist()):
            yield x.shape[1], w[places], x - means[x.shape[1]]

    models = {}
    for size, m in _gram(distinct.select("x", "n"), centred).items():
        n, each = sums[size]
        cov = (m + m.T) / (2 * n)
        values, vectors = np.linalg.eigh(cov)
        values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(cov))
        real = values[:components] > LEAST_SHARE * max(trace, 0.0)
        keep = int(real.sum())
        models[size] = Whitening(n, each, means[size], vectors[:, :keep].copy(), values[:keep].copy(), trace)
    return models


def whiten_embeddings(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
                      weighted: bool = False) -> DataFrame:
    """``(id, n, deviation, whitened, explained, identity_error)`` per row with a usable vector.

    ``whitened`` and ``explained`` are arrays with one entry per component,
    ``deviation`` is an exact DECIMAL(38, 0), ``n`` the sum of the fit weights. Rows
    whose vector is NULL, empty or holds a NULL, not finite or huge entry (2^56 or
    more) are left out. Vectors of different lengths are fitted apart. Components without
    variance are left out, so equal vectors alone give empty arrays. Repeated rows
    and NULL ids stay as they are. ``identity_error`` is measured on the whitened
    distinct vectors of that length.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), packed_vector(F.col(vector_col)).alias("x"))
    rows = stored(rows.where(F.col("x").isNotNull()), "vectors")
    distinct = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "distinct")
    models = fit_whitening(distinct, components, weighted)

    def whitened(batches):
        for batch in batches:
            packs = batch.column("x").to_pylist()
            size, far, out = [0] * len(packs), [0] * len(packs), [None] * len(packs)
            for places, x in unpack(packs):
                model = models[x.shape[1]]
                w, d = model.whiten(x.astype(float)), model.deviation(x)
                for k, p in enumerate(places):
                    size[p], far[p], out[p] = x.shape[1], d[k], w[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n"), pa.array(size, pa.int64()), pa.array(far, pa.decimal128(38, 0)), pa.array(out, pa.list_(pa.float64()))],
                names=["key", "n", "size", "deviation", "whitened"],
            )

    digest = F.unhex(F.md5("x")).alias("key")
    schema = "key binary, n bigint, size bigint, deviation decimal(38,0), whitened array<double>"
    once = stored(distinct.select(digest, "x", "n").mapInArrow(whitened, schema), "whitened")

    def again(batch):
        size, w = batch.column("size").to_numpy(), _weights(batch, weighted).astype(float)
        all_of = batch.column("whitened")
        for s in np.unique(size):
            places = np.flatnonzero(size == s)
            yield int(s), w[places], all_of.take(pa.array(places)).flatten().to_numpy().reshape(len(places), -1)

    errors = {s: np.abs(m / models[s].n - np.eye(len(m))).max(initial=0.0) for s, m in _gram(once.select("n", "size", "whitened"), again).items()}
    facts = spark.createDataFrame(
        [(s, m.n, [float(v / m.trace) for v in m.values], float(errors.get(s, 0.0))) for s, m in models.items()],
        "size bigint, fit_n bigint, explained array<double>, identity_error double",
    )
    # One row per length of vector, each of which has a model on the driver.
    once = once.join(F.broadcast(facts), "size")
    keyed = rows.select("id", digest)
    # A vector with more than one row in HOT_SHARE is one of at most HOT_SHARE vectors.
    is_hot = F.col("n") * HOT_SHARE > F.lit(rows.count())
    hot = once.where(is_hot)
    cold = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").join(once.where(~is_hot), "key")
    met = keyed.join(F.broadcast(hot), "key").unionByName(cold)
    return met.select("id", F.col("fit_n").alias("n"), "deviation", "whitened", "explained", "identity_error")
