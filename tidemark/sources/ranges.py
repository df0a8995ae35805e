"""Records of delimited text with line breaks inside quotes, from files that are split into byte ranges.

Spark reads the lines of every range on its own. Whether a range starts inside a quoted field depends on all text
before it, so a first pass works out for every range in which state it ends if it starts outside quotes and
if it starts inside. Chained in the order of the file these give the true state at the start of every range.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.stages import stored


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(line, file, start)``: the bytes of every line, its file and where its range begins; the rows of a range
    keep their order."""
    return spark.read.text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a line that begins inside or outside a quoted field ends inside one.

    A quote opens a field only as its first character and closes it unless doubled; what follows a closing
    quote up to the next separator belongs to the field as it is.
    """
    at, opening = 0, sep + b'"'
    while True:
        if not inside:
            if not line.startswith(b'"', at):
                found = line.find(opening, at)
                if found < 0:
                    return False
                at = found + len(sep)
            at += 1
        at = line.find(b'"', at)
        if at < 0:
            return True
        inside = line.startswith(b'"', at + 1)
        if inside:
            at += 2
            continue
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at += len(sep)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """The lines of each batch, cut where the range changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        kinds = files.indices.to_numpy()
        cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (starts[1:] != starts[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield files.dictionary[int(kinds[a])].as_py(), int(starts[a]), batch.column(0).slice(a, b - a).to_pylist()


def _effects(lines: DataFrame, sep: bytes) -> DataFrame:
    """One row per range with quotes: its last state for both first states, whether a line ends inside a field
    when it starts outside (``open``), and whether one ends outside when it starts inside (``closes``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "out": out, "into": into, "open": opened, "closes": closes}], schema)

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), *[(c, pa.bool_()) for c in ("out", "into", "open", "closes")]])
        now = None
        for file, start, some in _runs(batches):
            if now != (file, start):
                if now:
                    yield told()
                now, out, into, opened, closes = (file, start), False, True, False, False
            for line in some:
                same = out == into
                out = ends_inside(line, out, sep)
                into = out if same else ends_inside(line, into, sep)
                opened, closes = opened or out, closes or not into
        if now:
            yield told()

    # Lines without quotes leave either state as it is.
    quoted = lines.where(F.instr(F.col("line").cast("string"), '"') > 0)
    return quoted.mapInArrow(run, "file string, start long, out boolean, into boolean, open boolean, closes boolean")


class Borders:
    """For every file with a record of several lines: ranges with quotes, how each ends, and where the record
    that is open at its end began."""

    def __init__(self, effects: list):
        self.files: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_file: dict[str, list] = {}
        for r in sorted(effects, key=lambda r: (r["file"], r["start"])):
            by_file.setdefault(r["file"], []).append(r)
        for file, ranges in by_file.items():
            inside, opened, ends, begun = False, -1, [], []
            for r in ranges:
                passes_through = inside and not r["closes"]
                inside = r["into"] if inside else r["out"]
                opened = opened if passes_through else (r["start"] if inside else -1)
                ends.append(inside)
                begun.append(opened)
            self.files[file] = (np.array([r["start"] for r in ranges]), np.array(ends), np.array(begun))

    def crossed(self) -> bool:
        """Whether any record goes on into another range, as far as can be told from ranges with quotes."""
        return any(ends.any() for _, ends, _ in self.files.values())

    def before(self, file: str, start: int) -> int:
        """Where the record began that is open when a range starts; -1 if none is."""
        if file not in self.files:
            return -1
        starts, _, begun = self.files[file]
        at = bisect_left(starts, start)
        return int(begun[at - 1]) if at else -1

    def check(self, file: str, start: int) -> None:
        if file in self.files and start not in self.files[file][0]:
            raise RuntimeError(f"{file} was cut into other ranges than before; keep spark.sql.files.* and the number of cores, and read it anew")


def _assembled(lines: DataFrame, borders: Borders, sep: bytes, parts: bool) -> DataFrame:
    """Whole records without header and blank ones, or with ``parts`` the pieces of records in several ranges.

    Pieces tell where their record began (``opened``) and whether it is the first of its file (``head``).
    """
    shared = lines.sparkSession.sparkContext.broadcast(borders)  # a few bytes for each range
    schema = pa.schema([("record", pa.binary()), ("file", pa.string()), ("opened", pa.int64()), ("start", pa.int64()), ("head", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = shared.value

        def told(records: list[bytes], opened: int | None = None, head: bool = False) -> pa.RecordBatch:
            n = len(records)
            values = [records, [now[0]] * n, [opened] * n, [now[1]] * n, [head] * n]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

        def rest() -> Iterator[pa.RecordBatch]:
            """The record that is still open where its range ends."""
            if waiting and parts:
                yield told([b"\n".join(waiting)], begun if begun >= 0 else now[1], head and begun < 0)

        now, waiting, begun, inside, head = None, [], -1, False, False
        for file, start, some in _runs(batches):
            if now != (file, start):
                if now:
                    yield from rest()
                now, waiting, begun, head = (file, start), [], borders.before(file, start), start == 0
                inside = begun >= 0
            if file not in borders.files:
                records = [] if parts else some
            else:
                records = []
                for line in some:
                    waiting.append(line)
                    if b'"' in line:
                        borders.check(file, start)
                        inside = ends_inside(line, inside, sep)
                    if inside:
                        continue
                    record = b"\n".join(waiting)
                    waiting = []
                    if begun < 0:
                        records.append(record)
                    elif parts:
                        yield told([record], begun)
                    begun = -1
            records = [r for r in records if r.strip()]
            if head and records:
                head, records = False, records[1:]
            if records and not parts:
                yield told(records)
        if now:
            yield from rest()

    return lines.mapInArrow(run, "record binary, file string, opened long, start long, head boolean")


def records_of(spark: SparkSession, path: str, sep: str) -> DataFrame | None:
    """``(record, file)``: the bytes of every record but headers and blank ones, or None if each line is a record.

    Line breaks inside a record become ``\\n``. A field that never ends takes the text up to the end of its file.
    The driver and the tasks hold one entry for every range with quotes of the files that need it. Pieces of
    records that cross a border are stored, all other records are put together where they are read.
    """
    lines, mark = lines_of(spark, path), sep.encode()
    effects = stored(_effects(lines, mark), "ranges")
    needed = effects.where("open").select("file").distinct()
    found = effects.join(needed, "file", "left_semi").collect()
    if not found:
        return None
    borders = Borders(found)
    whole = _assembled(lines, borders, mark, parts=False).select("record", "file")
    if not borders.crossed():
        return whole
    pieces = stored(_assembled(lines, borders, mark, parts=True), "pieces")
    # A record's pieces as hexadecimal digits, so that they can be joined as text.
    joined = pieces.groupBy("file", "opened").agg(
        F.bool_or("head").alias("head"), F.array_sort(F.collect_list(F.struct("start", F.hex("record").alias("h")))).alias("p")
    ).where("NOT head")
    return whole.unionByName(joined.select(F.unhex(F.array_join(F.transform("p", lambda p: p["h"]), "0A")).alias("record"), "file"))
