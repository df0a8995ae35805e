"""Reading tables and profiling them."""

from __future__ import annotations

import codecs
import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.numeric import present
from tidemark.sources import ranges

# Separators tried in this order, and file endings that are refused.
SEPARATORS = [";", ",", "\t", "|"]
SPREADSHEETS = {"xls", "xlsx"}
# Words that stand for a missing value.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]


def _separator(lines: list[str]) -> str:
    header = lines[0] if lines else ""
    for sep in SEPARATORS:
        if len(next(csv.reader([header], delimiter=sep), [])) > 1:
            return sep
    try:
        return csv.Sniffer().sniff("\n".join(lines)).delimiter
    except csv.Error as error:
        raise ValueError("no separator found: the file has one column or none") from error


# Numbers as other tools write them; the plain cast would also take marks such as 1d, and is slow on words.
NUMBER = r"^[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"

WHOLE_NUMBER = r"^[+-]?[0-9]+$"


def load_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    schema: StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Delimited text with a header line, as spreadsheets and other tools write it.

    Fields may be quoted, with doubled quotes and line breaks inside (kept as ``\\n``); the usual words for a
    missing value give NULL; blanks around values are dropped; blank lines are skipped. The separator comes from
    the header. One pass over the text finds the column types (whole numbers, numbers, truth values, text) and
    whether all of it is UTF-8; otherwise it is read as Latin-1. Name ``encoding`` and ``schema`` to leave that
    pass out.

    Files are read by many tasks even if records span several lines: a first pass over the lines with quotes finds
    out which ranges of bytes start inside a field. Turn ``multi_line`` off to leave it out where no field holds
    line breaks. With it on, encodings other than UTF-8, Latin-1 and ASCII are read a file a task.
    """
    first = [bytes(r[0]) for r in spark.read.text(path).select(F.col("value").cast("binary")).limit(20).collect()]
    sep = sep or _separator([line.decode("latin-1") for line in first])
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"')
    # Latin-1 keeps every byte as one character, so the bytes can be looked at again.
    reader = reader.option("encoding", encoding or "ISO-8859-1")
    records = None
    if not _in_ranges(encoding):
        raw = reader.option("multiLine", multi_line).csv(path)
    else:
        records = ranges.records_of(spark, path, sep) if multi_line else None
        raw = reader.csv(path)
    if records is not None:
        encoded = encoding or "ISO-8859-1"
        raw = _parsed(records, _header(spark, path, sep, encoded), sep, encoded)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)

    def value(c: Column) -> Column:
        text = F.trim(c)
        return F.when(~text.isin(MISSING_WORDS), text)

    def utf8(c: Column) -> Column:
        return F.encode(c, "ISO-8859-1").cast("string")

    def wide(c: Column) -> Column:
        return F.octet_length(c) != F.length(c)

    found = None
    if schema is None or encoding is None:
        measures = []
        for i, c in enumerate(raw.columns):
            v = value(F.col(f"`{c}`"))
            measures += [
                F.count(v).alias(f"n{i}"), F.count(_number(v, "bigint")).alias(f"bigint{i}"), F.count(_number(v, "double")).alias(f"double{i}"),
                F.count_if(F.lower(v).isin("true", "false")).alias(f"boolean{i}"),
                F.count_if(F.when(wide(F.col(f"`{c}`")), ~F.is_valid_utf8(utf8(F.col(f"`{c}`"))))).alias(f"bad{i}"),
            ]
        found = raw.agg(*measures).first()
    recode = encoding is None and not any(found[f"bad{i}"] for i in range(len(raw.columns)))
    columns = []
    for i, c in enumerate(raw.columns):
        text = F.col(f"`{c}`")
        text = value(F.when(wide(text), utf8(text)).otherwise(text) if recode else text)
        if schema is not None:
            kind, name = schema.fields[i].dataType.simpleString(), schema.fields[i].name
        else:
            kinds = [k for k in ("bigint", "double", "boolean") if found[f"n{i}"] and found[f"{k}{i}"] == found[f"n{i}"]]
            kind, name = kinds[0] if kinds else "string", _recoded(c) if recode else c
        columns.append((text if kind == "string" else text.try_cast(kind)).alias(name))
    return raw.select(*columns)


def _number(v: Column, kind: str) -> Column:
    # A cast that fails is a hundred times slower than one that does not, so only texts of the right form are cast.
    return F.when(v.rlike(WHOLE_NUMBER if kind == "bigint" else NUMBER), v.try_cast(kind))


def _in_ranges(encoding: str | None) -> bool:
    try:
        return encoding is None or codecs.lookup(encoding).name in ("utf-8", "iso8859-1", "ascii")
    except LookupError:
        return False


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """Column names of the first record, which may have line breaks itself."""
    header, inside = [], False
    for r in spark.read.text(path).select(F.col("value").cast("binary")).limit(10_000).collect():
        line = bytes(r[0])
        if header or line.strip():
            inside = ranges.ends_inside(line, inside, sep.encode())
            header.append(line.decode(encoding))
            if not inside:
                break
    if inside:
        raise ValueError("the header does not end within 10,000 lines")
    mark = "\ufeff".encode().decode(encoding)
    names = next(csv.reader(["\n".join(header).removeprefix(mark)], delimiter=sep))
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _parsed(records: DataFrame, names: list[str], sep: str, encoding: str) -> DataFrame:
    """Every field of whole records as text."""
    text = F.decode("record", encoding)
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    return records.select(F.from_csv(text, fields, {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*").toDF(*names)


def _recoded(name: str) -> str:
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return name


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[str(c).strip() for c in df.columns])


def load_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by format name or file ending; unknown endings count as delimited text, bare names as tables."""
    ending = fmt or (path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "")
    if ending in SPREADSHEETS:
        raise ValueError("spreadsheet files are not read here; save the sheet as CSV or parquet")
    if ending == "table" or (not ending and "/" not in path and spark.catalog.tableExists(path)):
        df = spark.table(path)
    elif ending == "parquet":
        df = spark.read.parquet(path)
    elif ending in {"json", "jsonl"}:
        df = spark.read.json(path)
    else:
        df = load_delimited(spark, path, **options)
    if len(df.columns) <= 1:
        raise ValueError(f"{path} has one column or none")
    return clean_names(df)


def table_profile(df: DataFrame, distinct: str | None = None) -> DataFrame:
    """One row per column: position, type, rows and nulls (NaN included), in one scan without a shuffle of cells.

    ``distinct`` adds the number of distinct values: ``"exact"`` (every distinct value of every column is shuffled)
    or ``"approx"``.
    """
    if distinct not in (None, "exact", "approx"):
        raise ValueError(f"unknown way to count distinct values {distinct!r}")
    count = {"exact": lambda c: F.count_distinct(c), "approx": F.approx_count_distinct}.get(distinct)
    fields = list(enumerate(df.schema.fields))
    real = {f.name for _, f in fields if f.dataType.simpleString() in ("float", "double")}
    value = {f.name: present(f"`{f.name}`") if f.name in real else F.col(f"`{f.name}`") for _, f in fields}
    one = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(value[f.name]).alias(f"n_{i}") for i, f in fields],
        *([count(value[f.name]).alias(f"d_{i}") for i, f in fields] if count else []),
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("type"),
            F.col("_n").alias("row_count"), (F.col("_n") - F.col(f"n_{i}")).alias("null_count"),
            *([F.col(f"d_{i}").alias("distinct_count")] if count else []),
        )
        for i, f in fields
    ]
    return one.select(F.inline(F.array(*rows)))


def column_names(df: DataFrame) -> list[str]:
    return list(df.columns)
