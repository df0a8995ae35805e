"""Personal data: base spans against the plain patterns, the method's spans against planted cases and SQL."""

import random
import re
import time

import duckdb
import pytest
from compare import differences

from tidemark.llm import pii
from tidemark.llm.queries import ORACLES, QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and plain_luhn(digits)
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((kind, *m.span()))
    return sorted(out)


def with_check_digit(rng, n, separator):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    digits += next(d for d in "0123456789" if plain_luhn(digits + d))
    return separator.join(digits[i : i + 4] for i in range(0, n, 4))


def random_texts(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        parts = []
        for _ in range(rng.randint(1, 8)):
            parts.append(rng.choice([
                lambda: "".join(rng.choice("ab0159 .-+()@%é_") for _ in range(rng.randint(1, 25))),
                lambda: ".".join(str(rng.choice([0, 7, 255, 256, "0099", 1000])) for _ in range(rng.randint(2, 10))),
                lambda: with_check_digit(rng, rng.randint(11, 20), rng.choice(["", " ", "-"])),
                lambda: "+" + "".join(rng.choice("0123456789 -().") for _ in range(rng.randint(6, 22))),
                lambda: rng.choice([" a.b@c.d_e@f.g", "x@y", "@@a@b.c.", "é@a.b", "a@b..c", "phone ", "ssn: ", "order ", "Contact"]),
                lambda: rng.choice(["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE88370400440532013000", "123-45-6789"]),
                lambda: rng.choice(["(212) 555-0147", "212.555.0147", "+1 (826) 555-4081 190.137.223.204", "+1-826-555-40819"]),
            ])())
        yield rng.choice(["", " ", "\n"]).join(parts)


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_the_plain_patterns(seed):
    for text in random_texts(seed, 2000):
        assert sorted(pii.base_spans(text)) == plain_base(text), text


def test_query_equals_sql_on_random_texts(spark, tmp_path):
    """Both parts, the base kinds and the spans of this method."""
    rows = [(i, t, "x") for i, t in enumerate(random_texts(9, 3000))] + [(0, "a@b.c", "y"), (None, "a@b.c", None), (-1, None, "x"), (-2, "", "")]
    spark.createDataFrame(rows, "doc_id long, text string, pii string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op13_pii"](spark, str(tmp_path))
    assert differences(got, con, ORACLES["op13_pii"]) == []
    kinds = {s.split(":")[0] for r in got.collect() for s in r["spans"].split(",") if s}
    assert kinds == set(pii.KINDS)


def told(text):
    return [(pii.KINDS[s.kind], text[s.start : s.end], s.base) for s in pii.find_spans(text)]


def test_planted_cases():
    assert told("IBAN GB82 WEST 1234 5698 7654 32 PLEASE PAY") == [("iban", "GB82 WEST 1234 5698 7654 32", False)]
    assert told("GB83 WEST 1234 5698 7654 32") == [] and told("xGB82WEST12345698765432") == []
    assert told("my SSN is 123-45-6789") == [("ssn", "123-45-6789", False)]
    assert told("part 123-45-6789") == [] and told("ssn 000-45-6789") == []
    assert told("call (212) 555-0147 now") == [("phone", "(212) 555-0147", False)]
    assert told("microphone 212 555 0147") == []
    assert told("+1 (826) 555-4081 190.137.223.204") == [("phone", "+1 (826) 555-4081", False), ("ip", "190.137.223.204", True)]
    assert told("1234 4111111111111111 77") == [("card", "4111111111111111", False)]
    assert told("order test 1234 4111111111111111 77") == []
    assert told("4111 1111 1111 1111") == [("card", "4111 1111 1111 1111", True)]
    assert told("one two three 1234567890123456, 3.14.15, a@b") == []


def test_context_words():
    spans = {s.kind: s.score for s in pii.find_spans("Mail me: a@b.cd")}
    assert spans == {0: 1.0}
    assert [s.score for s in pii.find_spans("a@b.cd")] == [0.8]
    assert [s.score for s in pii.find_spans("sample a@b.cd")] == [0.6]
    # A word that the window cuts does not count, one that ends it does.
    assert pii.context_words("phone" + " " * 35 + "1", 40, 41) == {"phone"}
    assert pii.context_words("xphone" + " " * 35 + "1", 41, 42) == set()
    assert pii.context_words("1" + " " * 15 + "phone", 0, 1) == {"phone"}
    assert pii.context_words("1" + " " * 15 + "phones", 0, 1) == set()


def test_rows_and_redaction(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a@b.cd, 10.0.0.1", 6), (3, "a@b.cd, 10.0.0.1", 6), (4, "plain", None), (None, "+12345678901", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii int")
    got = pii.find_personal_data(docs, redacted=True)
    assert got.columns == ["doc_id", "text", "pii", "redacted"]
    found = [(r["doc_id"], [(s["kind"], s["value"]) for s in r["pii"]], r["redacted"]) for r in got.collect()]
    both = (3, [("email", "a@b.cd"), ("ip", "10.0.0.1")], "[email], [ip]")
    assert found == [(1, [], None), (2, [], ""), both, both, (4, [], "plain"), (None, [("phone", "+12345678901")], "[phone]")]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_overlapping_spans_are_replaced_once():
    text = "x +4111111111111111 y"
    spans = [pii.Span(2, 3, 19, True, 1.0), pii.Span(3, 2, 19, True, 1.0)]
    assert pii.redact(text, spans) == "x [phone] y"


@pytest.mark.parametrize("unit", ["1", "a", "1.", "1-", "+1", "+1 ", "a@", "a@b", "a@b.", "@", "GB82", "A1 ", "1 ", "(", "a.b@c-"])
def test_time_is_in_proportion_to_the_text(unit):
    def seconds(many):
        start = time.perf_counter()
        pii.find_spans(unit * many)
        return time.perf_counter() - start

    assert seconds(400_000) < max(2.0, 12 * seconds(50_000) + 0.5)
