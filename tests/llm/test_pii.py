import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traitweave.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="01259ab@..+- ()é4%", max_size=40))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "a.b@c.de", "x@y", "10.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8", " ", "-", ".", "@", "é"]), max_size=12))
def test_base_spans_in_mixtures(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


def test_added_spans():
    found = {k: text[s:e] for text in [
        "two numbers 4465758382889437 4465758382889437 side by side"] for k, s, e, _, base in pii.spans(text) if not base}
    number = "4465758382889437"
    assert pii.luhn(number) == ("card" in found)
    text = "card 4111111111111111 4012888888881881 and account DE89 3704 0044 0532 0130 00 X"
    kinds = [(k, text[s:e]) for k, s, e, _, base in pii.spans(text) if not base]
    assert ("card", "4111111111111111") in kinds and ("card", "4012888888881881") in kinds
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds
    assert not [x for x in pii.spans("DE88 3704 0044 0532 0130 00") if x[0] == "iban"]


def test_context_decides():
    assert [x[0] for x in pii.spans("her phone: 555-123-4567")] == ["phone"]
    assert pii.spans("part 555-123-4567") == []
    assert [x[0] for x in pii.spans("SSN 123-45-6789")] == ["national_id"]
    near, far = pii.spans("email: a@b.cd")[0], pii.spans("q: a@b.cd")[0]
    assert near[3] > far[3] and near[4] and far[4]


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "a@" * 500_000, "+1 " * 500_000, "a." * 200_000 + "@"):
        pii.spans(text)


def test_column(spark):
    rows = spark.createDataFrame([(None,), ("",), ("mail é a@b.cd",)], "text string").select(pii.find_pii(F.col("text")).alias("p")).collect()
    assert rows[0].p == [] and rows[1].p == []
    assert [(x.kind, x.start, x.end, x.base) for x in rows[2].p] == [("email", 7, 13, True)]
