"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Spans of the base kinds are always reported. Spans that this method adds (IBANs, social security numbers,
national telephone numbers, and numbers that a longer base proposal hid) need a score of ``LEAST``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import widened

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
LEAST = 0.5
BEFORE, AFTER = 40, 20  # code points beside a span in which context words count
FOR, AGAINST = 0.3, 0.2  # what context words add or take

# Scores before context: base kinds, and the proposals of this method.
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6}
ADDED_SCORE = {"iban": 0.8, "ssn": 0.3, "national": 0.3, "international": 0.6, "run": 0.6}
# The kind that each added proposal is reported as.
ADDED_KIND = {"iban": "iban", "ssn": "ssn", "national": "phone", "international": "phone", "run": "card"}

CONTEXT = {
    "email": ("contact", "email", "mail", "write"),
    "ip": ("address", "host", "ip", "server"),
    "card": ("card", "credit", "debit", "mastercard", "payment", "visa"),
    "phone": ("call", "cell", "fax", "mobile", "phone", "tel", "telephone"),
    "iban": ("account", "bank", "iban", "transfer"),
    "ssn": ("security", "social", "ssn", "taxpayer"),
}
DOUBTS = ("example", "invoice", "isbn", "order", "sample", "serial", "test", "version")

# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Patterns without a least number of repeats match wherever they begin, so long runs are read once.
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
HYPHENATED = re.compile(r"[0-9]+(?:-[0-9]+)*")
SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})")
NATIONAL = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")
INTERNATIONAL = re.compile(r"\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}")
DIGIT = re.compile(r"[0-9]")
LETTERS = re.compile(r"[a-z]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    base: bool
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_holds(compact: str) -> bool:
    """The length of the country and the remainder by 97."""
    turned = "".join(str(int(c, 36)) for c in compact[4:] + compact[:4])
    return len(compact) == IBAN_LENGTHS.get(compact[:2]) and int(turned) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ so that long runs of letters are read once."""
    end = seen = 0
    at = text.find("@")
    while at >= 0:
        first = max(end, seen)
        start = at - len(text[first:at]) + len(text[first:at].rstrip(LOCAL))
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        seen = at + 1
        at = text.find("@", seen)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at most 255, taken from the left of every chain of numbers and dots."""
    for chain in CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = list(NUMBER.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            values = [p[0].lstrip("0") for p in parts[i : i + 4]]
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                yield parts[i].start(), parts[i + 3].end()


def _digits(found: str) -> str:
    return "".join(DIGIT.findall(found))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of the four base kinds."""
    for start, end in emails(text):
        yield "email", start, end
    if not DIGIT.search(text):
        return
    for start, end in addresses(text):
        yield "ip", start, end
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()


def _stands_alone(text: str, start: int, end: int, letters: bool = False) -> bool:
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    return not any("0" <= c <= "9" or letters and (c.isascii() and c.isalpha()) for c in beside)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """``(proposal, start, end)`` of what this method adds, confirmed by its checksums and forms."""
    if not DIGIT.search(text):
        return
    for m in IBAN.finditer(text):
        size, places = IBAN_LENGTHS.get(m[0][:2], 0), [i for i, c in enumerate(m[0]) if c != " "]
        if 0 < size <= len(places):
            end = m.start() + places[size - 1] + 1
            if iban_holds(text[m.start() : end].replace(" ", "")) and _stands_alone(text, m.start(), end, letters=True):
                yield "iban", m.start(), end
    for m in HYPHENATED.finditer(text):
        digits = m[0].replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "run", *m.span()
        elif s := SSN.fullmatch(m[0]):
            if s[1] not in ("000", "666") and s[1] < "900" and s[2] != "00" and s[3] != "0000":
                yield "ssn", *m.span()
    for name, pattern in (("national", NATIONAL), ("international", INTERNATIONAL)):
        for m in pattern.finditer(text):
            if _stands_alone(text, *m.span()):
                yield name, *m.span()


def context_words(text: str, start: int, end: int) -> set[str]:
    """Words that stand wholly within the window beside a span."""
    padded = f" {text[max(0, start - BEFORE - 1):start]}" if start <= BEFORE else text[start - BEFORE - 1 : start]
    after = text[end : end + AFTER + 1]
    left = padded.translate(LOWER)
    right = (after + " " if len(after) <= AFTER else after).translate(LOWER)
    return {*LETTERS.findall(left.lstrip("abcdefghijklmnopqrstuvwxyz")), *LETTERS.findall(right.rstrip("abcdefghijklmnopqrstuvwxyz"))}


def _score(text: str, kind: str, first: float, start: int, end: int) -> float:
    words = context_words(text, start, end)
    score = first + FOR * (not words.isdisjoint(CONTEXT[kind])) - AGAINST * (not words.isdisjoint(DOUBTS))
    return round(min(1.0, max(0.0, score)), 6)


def find_spans(text: str | None) -> list[Span]:
    """Base spans, and added ones that overlap no base span and no better added one; by start, kind and end."""
    if not text:
        return []
    base = [
        Span(start, KINDS.index(kind), end, True, _score(text, kind, BASE_SCORE[kind], start, end))
        for kind, start, end in base_spans(text)
    ]
    added = []
    for name, start, end in proposals(text):
        kind = ADDED_KIND[name]
        score = _score(text, kind, ADDED_SCORE[name], start, end)
        if score >= LEAST:
            added.append(Span(start, KINDS.index(kind), end, False, score))
    if added:
        added = _disjoint(base, added)
    return sorted([*base, *added])


def _disjoint(base: list[Span], added: list[Span]) -> list[Span]:
    """Added spans without a base span or a better added span across them."""
    # All spans are short or disjoint within their pattern, so a sweep over the starts meets few at a time.
    kept, open_ = set(added), []
    for span in sorted([*base, *added]):
        open_ = [o for o in open_ if o.end > span.start]
        for other in open_:
            if span.base != other.base:
                kept.discard(other if span.base else span)
            elif not span.base and span != other:
                kept.discard(max(span, other, key=_rank))
        open_.append(span)
    return list(kept)


def _rank(span: Span) -> tuple:
    return -span.score, span.start, span.kind, span.end


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double,value:string>>"


def find_personal_data(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """Add ``pii``, the personal data in each whole text, and with ``redacted`` also the text without it.

    ``pii`` is an array of ``(kind, start, end, base, score, value)`` by start, kind and end, in code points
    with exclusive ends. Kinds are those of ``KINDS``. ``redacted`` holds the text with every span replaced by
    its kind in square brackets; of overlapping spans the text from the first one's start to the last one's
    end is replaced by the first one's kind. A null or empty text has no spans, and stays as it is when
    redacted; repeated rows stay; columns named like the new ones are replaced. Rows are independent, and the
    time is in proportion to the length of the text.
    """
    new = {"pii": SPANS} | ({"redacted": "string"} if redacted else {})
    kept = [c for c in docs.columns if c not in new]
    inner = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))
    schema = widened(inner.select(*[F.col(f"`{c}`") for c in kept]), **new)
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64()),
              ("value", pa.string())]
    kind = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, clean = [], []
            for t in batch.column(len(kept)).to_pylist():
                spans = find_spans(t)
                found.append([
                    {"kind": KINDS[s.kind], "start": s.start, "end": s.end, "base": s.base, "score": s.score, "value": t[s.start : s.end]}
                    for s in spans
                ])
                if redacted:
                    clean.append(redact(t, spans))
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(found, kind)]
            if redacted:
                columns.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return inner.mapInArrow(run, schema)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with spans replaced by their kinds."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        first, end = spans[i], spans[i].end
        while i < len(spans) and spans[i].start < max(end, first.start + 1):
            end = max(end, spans[i].end)
            i += 1
        out += [text[at : first.start], f"[{KINDS[first.kind]}]"]
        at = end
    return "".join([*out, text[at:]])
