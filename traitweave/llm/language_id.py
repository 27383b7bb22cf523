"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its subwords: the character n-grams
(1 to 4, lower case, with a mark at both ends) of its words, hashed into a fixed
number of buckets. A linear layer and a softmax give the language. Both are
trained by stochastic gradient descent in numpy, on a bounded sample of labelled
rows whose subword counts executors compute from the whole texts. A part of the
sample is set aside to calibrate: one temperature that makes the scores honest,
and the score below which a prediction is rejected.

The sample is fitted by one task, so the driver holds nothing but the result: the
embeddings and the layer fold into one matrix of buckets by languages. Prediction
is one pass in which tasks receive that matrix (a fixed size).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_array, mix, prepare, text_slices

#: Buckets, embedding width, n-gram lengths.
BUCKETS, WIDTH, LENGTHS = 1 << 14, 16, (1, 2, 3, 4)
#: Labelled rows that the model is fitted on (the bound of the sample), and the part of them set aside.
SAMPLE_ROWS, CALIBRATE = 2_000, 0.25
#: At most so many of a thousand right predictions may be rejected.
REJECT_PER_THOUSAND = 1
UNKNOWN = "und"

# Letters by code point below 0x3000; above that everything that Python calls a letter is looked up.
_LOW = 0x3000
_LETTER = np.fromiter((chr(c).isalpha() for c in range(_LOW)), dtype=bool, count=_LOW)
_LOWER = np.fromiter((ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_LOW)), dtype=np.uint32, count=_LOW)
_MARK = np.uint32(0x5F)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and row offsets in them."""
    head = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(head)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32), count[offsets]


def subwords(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every subword of the rows."""
    points, offsets = _code_points(data, offsets)
    low = np.minimum(points, _LOW - 1)
    letter = _LETTER[low]
    high = np.flatnonzero(points >= _LOW)
    if len(high):
        letter[high] = np.fromiter((chr(c).isalpha() for c in points[high]), dtype=bool, count=len(high))
    points = np.where(points < _LOW, _LOWER[low], points)
    # Every row ends with a gap; every gap next to a letter becomes a mark.
    n = len(points) + len(offsets)
    at = np.arange(len(points)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    text = np.zeros(n, np.uint32)
    text[at] = np.where(letter, points, 0)
    row = np.zeros(n, np.int64)
    row[at] = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    row[offsets[:-1] + np.arange(len(offsets) - 1)] = np.arange(len(offsets) - 1)
    inside = text != 0
    edge = ~inside
    edge[1:-1] &= inside[2:] | inside[:-2]
    edge[0], edge[-1] = inside[1] if n > 1 else False, inside[-2] if n > 1 else False
    value = np.where(edge, np.uint64(_MARK), text.astype(np.uint64))
    usable = inside | edge
    rows, out = [], []
    h = np.zeros(n, np.uint64)
    ok = np.ones(n, bool)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, max(LENGTHS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        h = h[:m] * factor + value[k - 1:]
        ok = ok[:m] & usable[k - 1:]
        if k > 2:
            ok[:m] &= inside[k - 2:k - 2 + m]  # a mark only at the ends
        if k in LENGTHS:
            here = np.flatnonzero(ok & (inside[:m] | inside[k - 1:]) if k < 3 else ok)
            out.append((mix(h[here] + np.uint64(k)) & np.uint64(buckets - 1)).astype(np.int64))
            # A gap belongs to the letter beside it.
            rows.append(np.where(inside[here], row[here], row[np.minimum(here + 1, n - 1)]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(out)


_COUNTS = "struct<bucket:array<int>,n:array<int>>"


def subword_counts(text: Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of a text and how often each occurs; at most ``buckets`` of them."""

    @F.arrow_udf(_COUNTS)
    def counted(texts: pa.Array) -> pa.Array:
        ids, counts, sizes = [], [], []
        for _, data, offsets in text_slices(texts):
            n = len(offsets) - 1
            row, bucket = subwords(data, offsets, buckets)
            key, count = np.unique(row * buckets + bucket, return_counts=True)
            sizes.append(np.bincount(key // buckets, minlength=n))
            ids.append(key % buckets)
            counts.append(count)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (ids, counts)]
        return pa.StructArray.from_arrays([list_array(x.astype(np.int32), bounds, pa.int32()) for x in flat], ["bucket", "n"])

    return counted(text)


@dataclass
class LanguageModel:
    """Languages, a matrix of buckets by languages, a temperature and the least score accepted."""

    labels: list[str]
    matrix: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept_from: float = 0.0

    def scores(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities per row, and its number of subwords."""
        sizes = np.bincount(row, minlength=rows)
        sums = np.stack([np.bincount(row, weights=self.matrix[bucket, k], minlength=rows) for k in range(len(self.labels))], axis=1)
        return softmax((sums / np.maximum(sizes, 1)[:, None] + self.bias) / self.temperature), sizes


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], buckets: int = BUCKETS, width: int = WIDTH,
        epochs: int = 8, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """Train on ``(buckets, counts)`` per text; the same rows in the same order give the same model."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart = order[:int(len(y) * CALIBRATE)] if len(y) >= 8 else order[:0]
    train = order[len(apart):]
    emb = rng.normal(0, 1 / width, (buckets, width))
    layer, bias = np.zeros((width, len(names))), np.zeros(len(names))
    steps, total = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, n = texts[i]
            if not len(ids):
                continue
            share = n / n.sum()
            hidden = share @ emb[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            step = rate * (1 - steps / total)
            steps += 1
            back = layer @ p
            layer -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            emb[ids] -= step * share[:, None] * back
    model = LanguageModel(names, emb @ layer, bias)
    _calibrate(model, [texts[i] for i in apart], y[apart])
    return model


def _calibrate(model: LanguageModel, texts: list, y: np.ndarray) -> None:
    """Temperature of least loss on the rows set aside; then the score that all but a few right predictions reach."""
    held = [(ids, n / n.sum(), k) for (ids, n), k in zip(texts, y, strict=True) if len(ids)]
    if not held:
        return
    z = np.array([share @ model.matrix[ids] + model.bias for ids, share, _ in held])
    y = np.array([k for *_, k in held])
    grid = np.geomspace(0.25, 16.0, 49)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    # Near an even share nothing is told apart; the calibrated bound only lowers that, so a text in two languages passes.
    even = 1 / len(model.labels)
    if len(right):
        model.accept_from = float(min(right[int(len(right) * REJECT_PER_THOUSAND / 1000)] * 0.9, even + 0.1 * (1 - even)))


def _fit_task(max_rows: int):
    """One task fits the sample; it returns the folded model as one row."""

    def fitted(batches):
        labels, texts = [], []
        for batch in batches:
            labels += batch.column("label").to_pylist()
            c = batch.column("c")
            ids, n = (c.field(k) for k in ("bucket", "n"))
            edges = ids.offsets.to_numpy()
            ids, n = ids.values.to_numpy(), n.values.to_numpy()
            # Views of the batch's buffers, not copies.
            texts += [(ids[a:b], n[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if not labels:
            return
        model = fit(texts[:max_rows], labels[:max_rows])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([model.labels]), pa.array([model.matrix.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias.tolist()], pa.list_(pa.float64())),
                pa.array([model.temperature]), pa.array([model.accept_from]),
            ],
            names=["labels", "matrix", "bias", "temperature", "accept_from"],
        )

    return fitted


def train_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                      max_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most ``max_rows`` labelled rows of ``docs``, taken in the order of a hash of the id.

    Rows with a NULL label or text are left out; rows that agree in id, text and
    label count once. Executors count the subwords of the whole texts and one of
    them fits: it receives at most ``max_rows`` times ``BUCKETS`` numbers, the driver
    the folded matrix only. Without a labelled row the model knows no language.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.where("label is not null and text is not null").withColumn("at", F.struct(F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"), F.col("label")))
    last = rows.select("at").distinct().orderBy("at").limit(max_rows).agg(F.max("at").alias("at")).first()["at"]
    if last is None:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    # The sample's texts are met where they are: no text is sorted.
    upto = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["t"]).alias("t"), F.lit(last["label"]).alias("label"))
    sample = rows.where(F.col("at") <= upto).select("at", "label", subword_counts(F.col("text")).alias("c"))
    once = sample.dropDuplicates(["at"]).orderBy("at").limit(max_rows)
    schema = "labels array<string>, matrix binary, bias array<double>, temperature double, accept_from double"
    r = once.select("label", "c").mapInArrow(_fit_task(max_rows), schema).first()
    matrix = np.frombuffer(r["matrix"], np.float32).reshape(BUCKETS, len(r["labels"]))
    return LanguageModel(list(r["labels"]), matrix, np.array(r["bias"]), r["temperature"], r["accept_from"])


def predict_language(text: Column, model: LanguageModel) -> Column:
    """``struct(lang, score, accepted)`` per whole text.

    ``und`` with score 0, not accepted: NULL and texts without a letter.
    Everything else gets the most likely language and its calibrated
    probability; below the calibrated least score it is not accepted. A model
    that knows no language says ``und`` with score 0 and accepts every text
    with a letter.
    """
    kept = LanguageModel(model.labels, model.matrix.astype(np.float32), model.bias, model.temperature, model.accept_from)

    @F.arrow_udf("struct<lang:string,score:double,accepted:boolean>")
    def predicted(texts: pa.Array) -> pa.Array:
        best, score, known = [], [], []
        for _, data, offsets in text_slices(texts):
            n = len(offsets) - 1
            row, bucket = subwords(data, offsets)
            if not kept.labels:
                known.append(np.bincount(row, minlength=n) > 0)
                best.append(np.zeros(n, int))
                score.append(np.zeros(n))
                continue
            p, sizes = kept.scores(row, bucket, n)
            best.append(p.argmax(axis=1))
            score.append(p.max(axis=1))
            known.append(sizes > 0)
        if not best:
            best, score, known = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, bool)]
        best, score, known = map(np.concatenate, (best, score, known))
        names = np.array([*kept.labels, UNKNOWN], dtype=object)
        lang = names[np.where(known, best, len(kept.labels))]
        score = np.where(known, score, 0.0)
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score), pa.array(known & (score >= kept.accept_from))], ["lang", "score", "accepted"]
        )

    return predicted(text)
