"""Personal data: regular expressions propose, checksums confirm, context words score.

``find_pii`` turns a text column into an array of spans. Base spans are those of
four fixed patterns; they stay whatever their score. The method adds spans that
the patterns miss: card numbers inside digit runs that fail as a whole, bank
account numbers (IBAN, mod 97), phone numbers without a plus sign and national
identity numbers; these need a checksum or a context word near by.

NULL and empty texts have no spans. Every pattern runs in linear time on any
text, so a text of many megabytes without a hit costs one pass.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "national_id"]
SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])

#: Characters before and after a span in which context words count, and the score from which an added span is kept.
CONTEXT_BEFORE, CONTEXT_AFTER, KEEP_FROM = 48, 24, 0.6

# Context words per kind (lower case, in the four languages of the tables and some others).
CONTEXT = {
    "email": ["email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt"],
    "ip": ["ip", "address", "host", "server", "client", "adresse", "dirección"],
    "card": ["card", "credit", "visa", "mastercard", "amex", "payment", "carte", "tarjeta", "karte", "kreditkarte"],
    "phone": ["phone", "tel", "telephone", "mobile", "call", "fax", "cell", "teléfono", "téléphone", "telefon", "handy"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "national_id": ["ssn", "social security", "national id", "sozialversicherung", "seguridad social", "sécurité sociale"],
}
# Words that speak against personal data.
AGAINST = ["version", "order", "invoice", "isbn", "issn", "sku", "serial", "build"]
# Total lengths of IBANs by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BARE_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")
_WORDS = {kind: re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b") for kind, words in CONTEXT.items()}
_NOT = re.compile(r"\b(?:" + "|".join(AGAINST) + r")\b")


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled; the sum of all digits ends in 0."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits go to the end, letters become 10 to 35; the rest by 97 is 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    """As ``local@domain`` searched from the left: every at sign is looked at once."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four fixed patterns, by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _DIGITS.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


def _proposals(text: str):
    """Spans beyond the fixed patterns: ``(kind, start, end, confirmed by a checksum)``."""
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 14:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            continue  # a base span
        # Numbers that stand side by side run into one match: each space-separated number, and
        # each run of four four-digit groups, is tried on its own.
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[0-9-]+", m[0])]
        i = 0
        while i < len(parts):
            for width in (4, 1):
                group = parts[i:i + width]
                if len(group) < width or width == 4 and any(e - s != 4 for s, e in group):
                    continue
                s, e = group[0][0], group[-1][1]
                number = text[s:e].replace(" ", "").replace("-", "")
                if 13 <= len(number) <= 19 and luhn(number):
                    yield "card", s, e, True
                    i += width - 1
                    break
            i += 1
    for m in _IBAN.finditer(text):
        country = IBAN_LENGTH.get(m[0][:2])
        if country:
            # A word in capitals may follow: the country's length decides where the number ends.
            end, left = m.start(), country
            while end < m.end() and left:
                left -= text[end] != " "
                end += 1
            number = text[m.start():end].replace(" ", "")
            if not left and mod97(number):
                yield "iban", m.start(), end, True
    for m in _NATIONAL.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "national_id", m.start(), m.end(), False
    for m in _BARE_PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield "phone", m.start(), m.end(), False


def _score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    around = text[max(0, start - CONTEXT_BEFORE):start].lower() + " \n " + text[end:end + CONTEXT_AFTER].lower()
    score = 0.7 if confirmed else 0.4
    if _WORDS[kind].search(around):
        score += 0.3
    if _NOT.search(around):
        score -= 0.2
    return round(min(1.0, max(0.0, score)), 3)


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans of one text, by kind and start; added spans never overlap others."""
    base = base_spans(text)
    out = [(k, s, e, _score(text, k, s, e, k in ("card", "email", "ip")), True) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    if any(c in text for c in "0123456789"):
        for kind, s, e, confirmed in _proposals(text):
            i = bisect.bisect_left(taken, (s, s))
            if i < len(taken) and taken[i][0] < e or i and taken[i - 1][1] > s:
                continue
            score = _score(text, kind, s, e, confirmed)
            if score >= KEEP_FROM:
                out.append((kind, s, e, score, False))
                bisect.insort(taken, (s, e))
    rank = {k: i for i, k in enumerate([*KINDS, *ADDED_KINDS])}
    return sorted(out, key=lambda x: (rank[x[0]], x[1]))


def find_pii(text: Column) -> Column:
    """Array of ``struct(kind, start, end, score, base)`` per text, in code points, end exclusive."""

    @F.arrow_udf(f"array<{SPAN}>")
    def found(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "end", "score", "base")
        return pa.array([[dict(zip(names, s, strict=True)) for s in spans(t)] if t else [] for t in texts.to_pylist()], pa.list_(_SPAN))

    return found(text)
