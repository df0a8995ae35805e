"""Delimited text over byte ranges: line breaks in quotes, odd quotes, encodings, against a plain reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ranges, tables


@pytest.fixture
def cut(spark):
    """Files cut into ranges of a given size."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def set_size(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield set_size
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def field(rng):
    return rng.choice([
        "plain", "", "a;b", "x\ny", "\n\n", 'say "hi"', "é ü", '"', "1.5", 'line\nwith; more\n"q"', "z" * rng.randint(1, 60),
        "\n".join(["long"] * rng.randint(1, 80)), "NA", '5"',
    ])


def meaning(value):
    value = value.strip(" ")
    return None if value in tables.MISSING_WORDS else value


@pytest.mark.parametrize("size", [1000, 7000, 10**8])
def test_any_ranges_give_the_same_records(spark, cut, tmp_path, size):
    rng = random.Random(3)
    rows = [[str(i), field(rng), field(rng), rng.choice(["tail", "t\nu"])] for i in range(1200)]
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, delimiter=";", lineterminator="\n")
            writer.writerow(["id", "a", "b", "two\nlines"])
            writer.writerows(rows[f::2])
    cut(size)
    got = tables.load_delimited(spark, str(tmp_path))
    assert got.dtypes == [("id", "bigint"), ("a", "string"), ("b", "string"), ("two\nlines", "string")]
    assert size > 7000 or got.rdd.getNumPartitions() >= 10
    assert sorted(tuple(r) for r in got.collect()) == sorted((int(r[0]), *map(meaning, r[1:])) for r in rows)


def test_one_field_over_many_ranges(spark, cut, tmp_path):
    long = "\n".join(f"line {i}" for i in range(2000))
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,"x\ny"\n3,z\n\n  \n4,"{long}"')
    cut(500)
    got = {r["k"]: r["v"] for r in tables.load_delimited(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {1: long, 2: "x\ny", 3: "z", 4: long}


@pytest.mark.parametrize("text, want", [
    # A quote within a field that is not quoted is a character like any other.
    ('k;v\n1;5" pipe\n2;"a\nb"\n3;6" pipe\n', [(1, '5" pipe'), (2, "a\nb"), (3, '6" pipe')]),
    ('k;v\r\n1;"a\r\nb"\r\n2;c\r\n', [(1, "a\nb"), (2, "c")]),
    ('\n\nk;v\n1;"a\nb"\n', [(1, "a\nb")]),
    ('k;v\n1;"never\nends\n', None),
    ('k;v\n1;x\n2;"y;""z"""\n', [(1, "x"), (2, 'y;"z"')]),
])
def test_odd_text(spark, cut, tmp_path, text, want):
    (tmp_path / "a.csv").write_bytes(text.encode())
    for size in (4, 1000):
        cut(size)
        got = sorted(tuple(r) for r in tables.load_delimited(spark, str(tmp_path / "a.csv")).collect())
        assert got == want if want else len(got) == 1


@pytest.mark.parametrize("encoding, named", [("utf-8", None), ("latin-1", None), ("utf-8-sig", None), ("UTF-16", "UTF-16"), ("latin-1", "ISO-8859-1"), ("utf-8", "UTF-8")])
def test_encodings(spark, tmp_path, encoding, named):
    (tmp_path / "a.csv").write_bytes('clé;note\n1;"é\nü"\n2;ñ\n'.encode(encoding))
    got = tables.load_delimited(spark, str(tmp_path / "a.csv"), sep=";", encoding=named)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "é\nü"), (2, "ñ")]
    assert got.columns == ["clé", "note"]


def test_numbers_and_words(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d,e\n1,1.5,1d,true,NaN\n-2,1e3,2,FALSE,3\n+3,inf,3,True,.5\n")
    got = tables.load_delimited(spark, str(tmp_path / "a.csv"))
    assert got.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "boolean"), ("e", "double")]
    assert [tuple(r) for r in got.collect()] == [(1, 1.5, "1d", True, None), (-2, 1000.0, "2", False, 3.0), (3, float("inf"), "3", True, 0.5)]


def test_state_of_a_line_equals_a_character_machine():
    def plain(line, inside, sep):
        state = "in" if inside else "start"
        for c in line:
            if state == "start":
                state = "in" if c == '"' else "start" if c == sep else "field"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote":
                state = "in" if c == '"' else "start" if c == sep else "field"
            elif c == sep:
                state = "start"
        return state == "in"

    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choice('a";;" ""') for _ in range(rng.randint(0, 14)))
        for inside in (False, True):
            assert ranges.ends_inside(line.encode(), inside, b";") == plain(line, inside, ";"), (line, inside)


def test_changed_ranges_are_noticed():
    found = [{"file": "f", "start": s, "out": True, "into": False, "open": True, "closes": True} for s in (0, 100, 200)]
    borders = ranges.Borders(found)
    assert [borders.before("f", s) for s in (0, 100, 200, 300)] == [-1, 0, -1, 200] and borders.before("g", 7) == -1
    borders.check("f", 100)
    with pytest.raises(RuntimeError):
        borders.check("f", 150)


def test_reader_agrees_with_the_csv_module(spark, tmp_path):
    rng = random.Random(8)
    rows = [[field(rng) for _ in range(3)] for _ in range(300)]
    buffer = io.StringIO(newline="")
    csv.writer(buffer, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["a", "b", "c"], *rows])
    (tmp_path / "a.csv").write_text(buffer.getvalue())
    got = tables.load_delimited(spark, str(tmp_path / "a.csv"), schema="a string, b string, c string", encoding="UTF-8")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(map(meaning, r)) for r in rows), key=str)


def test_only_whole_numbers_are_cast_to_whole_numbers(spark):
    """Any other cast would fail inside, which is slow; the types found are the same as by casts alone."""
    texts = ["1", "+2", "-3", "1.5", "12.", "1e3", ".5", "inf", "99999999999999999999", "x", "007", "1\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r["t"]: r["whole"] for r in df.select("t", tables._number(F.col("t"), "bigint").alias("whole")).collect()}
    casts = {r["t"]: r["whole"] for r in df.select("t", F.when(F.col("t").rlike(tables.NUMBER), F.col("t").try_cast("bigint")).alias("whole")).collect()}
    assert found == casts and found["007"] == 7 and found["12."] is None
    assert tables.WHOLE_NUMBER in tables._number(F.col("t"), "bigint")._jc.toString()
