"""Vector codes of a few bytes: each part of a vector becomes the number of its codebook's nearest entry.

The nearest entry is found by slice and intersect (after Nene and Nayar): each coordinate's sorted entry values
carry prefix masks, so the entries within a radius of a value are the difference of two masks; the masks of
all coordinates ANDed leave the entries of a cube around the part. The radius is the distance to some entry near
by, so the nearest entry and its ties are always among these candidates, whose distances are then exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, widened
from tidemark.llm.vectors import as_longs, doubles_hold, floors, matrix, paired_distances, squared_distances

CHUNK = 2048  # parts searched at a time
PIVOTS = 16  # entries tried for the initial radius, and neighbours of the best of them
FLUSH = 1 << 20  # rows whose sums surely fit into 64 bits


class Codebook:
    """Entries of one part position with the sorted coordinates' prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        many, dim = entries.shape
        words = -(-many // 64)
        self.sorted = np.sort(entries, axis=0)
        self.prefix = np.zeros((dim, many + 1, words), np.uint64)
        for j in range(dim):
            for rank, e in enumerate(np.argsort(entries[:, j], kind="stable").tolist()):
                self.prefix[j, rank + 1] = self.prefix[j, rank]
                self.prefix[j, rank + 1, e // 64] |= np.uint64(1 << (e % 64))
        self.pivots = np.arange(0, many, max(1, many // PIVOTS))
        between = squared_distances(entries[self.pivots], entries).astype(float)
        self.neighbours = np.argsort(between, axis=1, kind="stable")[:, :PIVOTS]

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For every row of ``x`` which entries differ by at most its radius in every coordinate."""
        mask = np.full((len(x), self.prefix.shape[2]), np.iinfo(np.uint64).max, np.uint64)
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, side="left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, side="right")
            mask &= self.prefix[j, high] ^ self.prefix[j, low]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return bits[:, : len(self.entries)].astype(bool)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers not below the distance to some entry: the best of a few and of that one's neighbours."""
        measured = squared_distances(x, self.entries[self.pivots])
        pivot = measured.argmin(1)
        best = measured[np.arange(len(x)), pivot]
        for column in self.neighbours[pivot].T:
            best = np.minimum(best, paired_distances(x, self.entries[column]))
        if best.dtype == object:
            return np.array([math.isqrt(int(d)) + 1 for d in best], np.int64)
        return np.sqrt(best).astype(np.int64) + 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (ties: the smaller one) and squared distance from it, for every row."""
        codes, errors = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            found = self.candidates(part, self.radius(part))
            kind = float if doubles_hold(part, self.entries) else object
            part, entries = part.astype(kind), self.entries.astype(kind)
            own, theirs = (part * part).sum(1), (entries * entries).sum(1)
            code, best = np.full(len(part), -1, np.int64), np.full(len(part), np.inf, kind)
            for e in np.flatnonzero(found.any(0)).tolist():
                rows = np.flatnonzero(found[:, e])
                away = own[rows] - 2 * (part[rows] @ entries[e]) + theirs[e]
                closer = away < best[rows]
                code[rows[closer]], best[rows[closer]] = e, away[closer]
            codes[at : at + CHUNK], errors[at : at + CHUNK] = code, as_longs(best)
        return codes, errors


class Codebooks:
    """The codebooks of all part positions; ``entries`` has the shape (parts, entries, components)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.books = [Codebook(e) for e in entries]
        self.dim = entries.shape[0] * entries.shape[2]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of the nearest entries, one column for each part."""
        size = self.entries.shape[2]
        found = [book.nearest(vectors[:, p * size : (p + 1) * size]) for p, book in enumerate(self.books)]
        return np.stack([c for c, _ in found], 1), np.stack([e for _, e in found], 1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _sums(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``(entry, at, n)``: members (at = -1) and sums of the components at each place of every used entry.

    Entries are numbered through all parts. A task adds up its own rows first.
    """
    parts, many, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            used = np.flatnonzero(members)
            entry = np.repeat(used, size + 1)
            at = np.tile(np.arange(-1, size), len(used))
            n = np.concatenate([members[used, None], sums[used]], axis=1).ravel()
            return pa.RecordBatch.from_arrays([pa.array(entry), pa.array(at), pa.array(n)], names=["entry", "at", "n"])

        members, sums, rows = np.zeros(parts * many, np.int64), np.zeros((parts * many, size), np.int64), 0
        for batch in batches:
            vectors = matrix(batch.column(0), books.dim)
            codes, _ = books.encode(vectors)
            for p in range(parts):
                entry = p * many + codes[:, p]
                members += np.bincount(entry, minlength=parts * many)
                np.add.at(sums, entry, vectors[:, p * size : (p + 1) * size])
            rows += len(vectors)
            if rows >= FLUSH:
                yield told()
                members[:], sums[:], rows = 0, 0, 0
        if rows:
            yield told()

    found = kept.select("ints").mapInArrow(run, "entry long, at long, n long")
    return found.groupBy("entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))


def train_codebooks(kept: DataFrame, first: np.ndarray, parts: int, rounds: int) -> Codebooks:
    """Codebooks that start as the parts of the ``first`` vectors and follow the floor of their members' mean."""
    entries = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        totals = {(r["entry"], r["at"]): int(r["n"]) for r in _sums(kept, Codebooks(entries)).collect()}
        flat = entries.reshape(-1, entries.shape[2])
        for (entry, at), total in totals.items():
            if at >= 0:
                flat[entry, at] = total // totals[entry, -1]
        entries = flat.reshape(entries.shape)
    return Codebooks(entries)


def compress_vectors(
    rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> tuple[DataFrame, Codebooks | None]:
    """The usable rows with ``code`` and ``error`` in place of their vectors, and the codebooks.

    A component x counts as the integer floor(scale * x), held to 2^40 in either direction; vectors that are null
    or hold null or non-finite components are left out. Vectors are cut into ``parts`` equal consecutive parts,
    after zeros have filled shorter ones up to the longest, and all up to a multiple of ``parts``. A codebook
    starts as that part of the vectors with the smallest ids (equal ids: the smaller vector first; null ids
    last). Each round assigns every part to the nearest entry (squared Euclidean distance, ties to the lower
    number) and moves used entries to the floor of their members' mean. ``code`` holds the numbers of the
    nearest entries in the order of the parts, two hex digits each (more for more than 256 entries); ``error`` is
    the squared distance from them, beyond 64 bits the largest long. Repeated rows count each by itself; other
    columns stay, but for ones named like the new ones; with fewer vectors there are fewer entries. Without
    usable vectors there are no rows and no codebooks.

    The driver holds the codebooks only (``entries`` times the length of a vector).
    """
    others = [c for c in rows.columns if c not in (embedding, "code", "error")]
    vector = floors(F.col(f"`{embedding}`"), scale)
    usable = rows.select(*[F.col(f"`{c}`") for c in others], vector.alias("ints" if "ints" not in others else "_ints"))
    ints = usable.columns[-1]
    kept = stored(usable.where(F.col(ints).isNotNull()), "integers")
    longest = kept.agg(F.max(F.size(ints))).first()[0]
    schema = widened(kept.drop(ints), code="string", error="long")
    if longest is None:
        return kept.select(*others, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    dim = max(1, -(-longest // parts)) * parts
    chosen = kept.orderBy(F.col(f"`{vec_id}`").asc_nulls_last(), ints).limit(entries).select(ints).collect()
    first = np.zeros((len(chosen), dim), np.int64)
    for row, r in zip(first, chosen):
        row[: len(r[0])] = r[0]
    books = train_codebooks(kept.select(F.col(ints).alias("ints")), first, parts, rounds)
    digits = max(2, len(f"{len(chosen) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.encode(matrix(batch.column(len(others)), dim))
            told = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            error = [min(sum(row), (1 << 63) - 1) for row in errors.tolist()]
            columns = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, pa.string()), pa.array(error, pa.int64())], names=[*others, "code", "error"])

    return kept.mapInArrow(run, schema), books
