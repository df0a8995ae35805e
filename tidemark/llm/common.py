"""Small helpers shared by the operators: tables in the shared folder, files for executors, words of texts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORDS = 1 << 20  # most words of 64 bits in a print of keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile deletes its shuffle files when done: else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back. The path is kept as ``df.stored_at`` for :func:`drop`."""
    path = scratch_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table written by :func:`stored` that no later job reads."""
    path = _hadoop_path(df.sparkSession, df.stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _sifted(big: DataFrame, keys: DataFrame, key: str, count: int) -> tuple[DataFrame, Column]:
    """``big`` with columns ``_word, _bits``, and whether a row's key may be among ``keys``; rows stay where they are.

    The keys are hashed to bits, 16 for each or more, as far as ``WORDS`` allows; the words of bits are broadcast.
    """
    words = min(WORDS, 1 << max(0, (count // 4).bit_length()))

    mixed = F.xxhash64(key)
    word = F.pmod(mixed, F.lit(words)).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(mixed, 32), F.lit(64)).cast("int"))
    table = keys.where(F.col(key).isNotNull()).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = big.withColumn("_word", word).join(F.broadcast(table), "_word", "left")
    return marked, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)) & F.col(key).isNotNull()


def perhaps_matching(big: DataFrame, keys: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """Like a :func:`matching` semi join, but a few other rows may be among the result where there are more keys."""
    count = keys.count()
    if count <= most:
        return big.join(F.broadcast(keys), key, "left_semi")
    marked, maybe = _sifted(big, keys, key, count)
    return marked.where(maybe).select(big.columns)


def matching(big: DataFrame, keys: DataFrame, key: str, how: str = "left_semi", most: int = 200_000) -> DataFrame:
    """Semi or anti join with a stored table of distinct long keys: broadcast if these are at most ``most``.

    Of more keys a print of bounded size is broadcast, and only rows that pass it are dealt out.
    """
    count = keys.count()
    if count <= most:
        return big.join(F.broadcast(keys), key, how)
    marked, maybe = _sifted(big, keys, key, count)
    found = marked.where(maybe).select(big.columns).join(keys, key, how).select(big.columns)
    return found if how == "left_semi" else marked.where(~maybe).select(big.columns).union(found)


def ship(spark: SparkSession, data: bytes, name: str) -> str:
    """Put ``data`` into the shared folder and let every executor fetch it; returns the name for ``SparkFiles.get``.

    For files whose size the caller has checked.
    """
    unique = f"{name}-{uuid.uuid4().hex[:12]}"
    target = f"{scratch_path(spark, 'files')}/{unique}"
    path = _hadoop_path(spark, target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for start in range(0, len(data), 1 << 22):
            out.write(bytearray(data[start : start + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(str(path.toString()))
    return unique


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with further columns, given as DDL types."""
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in columns.items()]
    return T.StructType([*df.schema.fields, *more])


def lower_ascii(text: Column | str) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on between tasks, and their allocators keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def thrifty(run):
    """A function over a task's batches that gives freed memory back when it ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column, without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def document_runs(offsets: np.ndarray, limit: int):
    """Ranges of consecutive documents with about ``limit`` bytes each; a longer document is a range of its own."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(offsets) - 1)
        yield start, end
        start = end


def whole_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut sorted batches so that no group of ``keys`` is split; a batch's last group waits for the next batch."""
    waiting: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        group = pdf[keys].to_numpy()
        first = waiting[0][keys].to_numpy()[0] if waiting else group[0]
        if (group[-1] == first).all():
            waiting.append(pdf)
            continue
        # 0 where the group that waits has ended with its batch and this batch is one other group.
        cut = int(np.flatnonzero(np.concatenate([[True], (group != group[-1]).any(1)]))[-1])
        yield pd.concat([*waiting, pdf.iloc[:cut]], ignore_index=True)
        waiting = [pdf.iloc[cut:]]
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def group_starts(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of every group of sorted rows."""
    group = pdf[keys].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
    return starts, np.diff([*starts, len(group)])
