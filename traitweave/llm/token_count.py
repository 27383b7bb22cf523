"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``chunk`` characters goes to the library as it is. A longer one
is encoded in chunks that overlap, with offsets. Two neighbouring chunks are
spliced at a position in the overlap at which both have a token boundary and
which is *proven stable*: no piece of the vocabulary holds the two characters
around it side by side, so no merge crosses it in any context. Both chunks need
one such boundary before the splice, so that neither the cut nor the space that
the library puts in front of a text reaches the tokens that are kept. If the
overlap has no such place it is doubled; in the end the chunk is the whole rest
of the text, which is exact as well.

NULL counts as empty: no bytes, no tokens. Memory per task is one chunk and its
tokens, not the text's.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a chunk and of the first overlap tried.
CHUNK, OVERLAP = 16_384, 512


class Counter:
    """Counts tokens with one SentencePiece model."""

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, min(overlap, chunk // 2)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        #: Pairs of characters that stand side by side in some piece.
        self.inner = {p.piece[i:i + 2] for p in proto.pieces for i in range(len(p.piece) - 1)}
        # Positions are only proven where the normaliser leaves the text as it is.
        norm = proto.normalizer_spec
        self.plain = norm.name == "identity" and not norm.remove_extra_whitespaces and not proto.denormalizer_spec.precompiled_charsmap

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if t and (len(t) <= self.chunk or not self.plain)]
        for i, ids in zip(small, self.encoder.encode([texts[i] for i in small], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if self.plain and len(t) > self.chunk:
                out[i] = self.spliced(t)
        return out

    def _stable(self, text: str, at: int) -> bool:
        return text[at - 1:at + 1].replace(" ", "▁") not in self.inner

    def _starts(self, text: str, lo: int, hi: int) -> list[int]:
        """Starts of the tokens of ``text[lo:hi]`` as positions of the text."""
        part = text[lo:hi]
        found = self.encoder.encode(part, return_type="proto")
        # The library's offsets are bytes.
        heads = (np.frombuffer(part.encode(), dtype=np.uint8) & 0xC0) != 0x80
        at = np.concatenate([np.cumsum(heads) - 1, [len(part)]])
        return (lo + at[[p.begin for p in found.pieces]]).tolist()

    def spliced(self, text: str) -> int:
        """Tokens of a long text."""
        n, total = len(text), 0
        lo, start = 0, 0  # the chunk's first character; the splice from which its tokens count
        hi = min(n, self.chunk)
        starts = self._starts(text, lo, hi)
        while hi < n:
            overlap = self.overlap
            while True:
                next_lo = max(lo, hi - overlap)
                next_hi = min(n, next_lo + max(self.chunk, 2 * overlap))
                following = self._starts(text, next_lo, next_hi)
                splice = self._splice(text, starts, following, start, next_lo, hi)
                if splice is not None:
                    break
                if next_hi == n and next_lo == lo:
                    # The rest of the text in one piece, from the last splice on.
                    return total + sum(s >= start for s in following)
                if next_lo == lo:
                    # The overlap is all of this chunk: widen the chunk itself.
                    hi, starts = next_hi, following
                    if hi == n:
                        return total + sum(s >= start for s in starts)
                    overlap = self.overlap
                    continue
                overlap *= 2
            total += sum(start <= s < splice for s in starts)
            lo, start, hi, starts = next_lo, splice, next_hi, following
        return total + sum(s >= start for s in starts)

    def _splice(self, text: str, left: list[int], right: list[int], start: int, lo: int, hi: int) -> int | None:
        """A stable boundary of both chunks, with a stable place before it in the right one and after it in the left one."""
        common = set(left).intersection(right)
        stable = [at for at in range(max(lo, start) + 1, hi) if self._stable(text, at)]
        # The last stable place only shows that the left chunk's cut is beyond the splice.
        return next((at for at in reversed(stable[1:-1]) if at in common), None)


@functools.lru_cache(maxsize=2)
def _counter(model: str, chunk: int, overlap: int) -> Counter:
    return Counter(model, chunk, overlap)


def count_tokens(text: Column, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens of each text (BIGINT, 0 for NULL) by the SentencePiece model file ``model``.

    The model file must be at the same path on every executor. Each Python
    worker loads it once.
    """

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(model, chunk, overlap).count(texts.fill_null("").to_pylist()), pa.int64())

    return counted(text)
