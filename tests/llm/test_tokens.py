import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from traitweave.llm.token_count import Counter  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def small():
    return Counter(MODEL, chunk=24, overlap=4)


def whole(counter, text):
    return len(counter.encoder.encode(text))


def test_long_texts_are_counted_exactly(small):
    rng = random.Random(1)
    pieces = ["the ", "tion", " ", "  ", "\n", "ß", "漢字", "𐍈", "é", "of", " and", "aaaa", "1234", "<s>", "▁", " ", "%%%", "é", "\u0000"]
    for n in (10, 60, 400):
        for _ in range(60):
            text = "".join(rng.choices(pieces, k=n))
            assert small.count([text]) == [whole(small, text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    counter = test_any_text.counter
    assert counter.count([text]) == [len(counter.encoder.encode(text))]


test_any_text.counter = Counter(MODEL, chunk=16, overlap=3)


def test_overlap_widens_where_nothing_is_stable(small):
    # A run of one letter or of spaces has no proven boundary at all.
    for text in ("a" * 500, " " * 500, "ab" * 300 + " c " + "a" * 200, "x " * 300):
        assert small.count([text]) == [whole(small, text)]


def test_batches(small):
    assert small.count(["", "a b", "x" * 100]) == [0, whole(small, "a b"), whole(small, "x" * 100)]
