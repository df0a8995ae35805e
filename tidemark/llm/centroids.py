"""Centroid clustering with heap-ordered bounds (after Hamerly and Drake), exact on integer vectors.

Vectors are packed into blocks. A block keeps one heap per cluster over the gaps between a vector's distance
from the second nearest centroid and from its own; keys are offset by the drift that the cluster had gathered
when the gap was measured. When centroids move only the offsets grow: vectors whose key is not above their
cluster's offset are popped and measured against all centroids again, all others cannot have changed sides.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, stored
from tidemark.llm.vectors import as_longs, floors, matrix, paired_distances, squared_distances

# Gaps are held smaller than measured by this share of the numbers that they come from, for their rounding.
CARE = 1e-9

BLOCK = pa.schema([
    ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("kind", pa.string()), ("cluster", pa.binary()), ("keys", pa.binary()),
    ("places", pa.binary()), ("sizes", pa.list_(pa.int64())), ("joined", pa.list_(pa.int64())), ("moved", pa.list_(pa.int64())),
    ("rescanned", pa.int64()),
])
BLOCK_DDL = (
    "ids array<bigint>, vectors binary, kind string, cluster binary, keys binary, places binary, sizes array<bigint>, "
    "joined array<bigint>, moved array<bigint>, rescanned bigint"
)


class Block:
    """Vectors, their clusters and a heap of ``(key, place)`` for each cluster."""

    def __init__(self, vectors: np.ndarray, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.vectors, self.cluster, self.heaps = vectors, cluster, heaps

    @classmethod
    def fresh(cls, vectors: np.ndarray, many: int) -> Block:
        """Nobody has a cluster yet: every vector has to be measured."""
        return cls(vectors, np.full(len(vectors), -1, np.int32), [[] for _ in range(many)])

    @classmethod
    def read(cls, row: dict, dim: int) -> Block:
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dim).astype(np.int64)
        keys, places = np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["places"], np.int32).tolist()
        heaps, at = [], 0
        for size in row["sizes"]:
            heaps.append(list(zip(keys[at : at + size], places[at : at + size])))
            at += size
        return cls(vectors, np.frombuffer(row["cluster"], np.int32).copy(), heaps)

    def advance(self, centroids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Measure the vectors whose gap has expired; returns what members and sums of clusters change by."""
        expired = np.flatnonzero(self.cluster < 0).tolist()
        for heap, offset in zip(self.heaps, offsets):
            while heap and heap[0][0] <= offset:
                expired.append(heapq.heappop(heap)[1])
        joined, moved = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        places = np.array(expired, np.int64)
        if not len(places):
            return joined, moved, 0
        measured = squared_distances(self.vectors[places], centroids)
        now = measured.argmin(1).astype(np.int32)
        rows = np.arange(len(places))
        near = np.sqrt(measured[rows, now].astype(float))
        if len(centroids) > 1:
            rest = measured.astype(float)
            rest[rows, now] = np.inf
            far = np.sqrt(rest.min(1))
            keys = far - near - CARE * (far + near) + offsets[now] * (1 - CARE)
        else:
            keys = np.full(len(places), np.inf)
        for key, place, c in zip(keys.tolist(), expired, now.tolist()):
            heapq.heappush(self.heaps[c], (key, place))
        before = self.cluster[places]
        went = before != now
        self.cluster[places] = now
        for sign, side, who in ((1, now, went), (-1, before, went & (before >= 0))):
            np.add.at(joined, side[who], sign)
            np.add.at(moved, side[who], sign * self.vectors[places[who]])
        return joined, moved, len(places)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        return as_longs(paired_distances(self.vectors, centroids[self.cluster]))

    def row(self, ids: pa.Array, joined: np.ndarray, moved: np.ndarray, rescanned: int) -> pa.RecordBatch:
        most = int(np.abs(self.vectors).max(initial=0))
        kind = next(k for k in ("int8", "int16", "int32", "int64") if most <= np.iinfo(k).max)
        heap = [entry for h in self.heaps for entry in h]
        values = {
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "vectors": [self.vectors.astype(kind).tobytes()], "kind": [kind], "cluster": [self.cluster.tobytes()],
            "keys": [np.array([k for k, _ in heap], float).tobytes()], "places": [np.array([p for _, p in heap], np.int32).tobytes()],
            "sizes": [[len(h) for h in self.heaps]], "joined": [joined.tolist()], "moved": [moved.ravel().tolist()],
            "rescanned": [rescanned],
        }
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name != "ids" else values["ids"] for f in BLOCK], schema=BLOCK)


def _started(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks of about one Arrow batch each, every vector measured once."""
    many, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = Block.fresh(matrix(batch.column(1), dim), many)
                yield block.row(batch.column(0), *block.advance(centroids, np.zeros(many)))

    return kept.select("vec_id", "ints").mapInArrow(run, BLOCK_DDL)


def _advanced(blocks: DataFrame, centroids: np.ndarray, offsets: np.ndarray, last: bool) -> DataFrame:
    """The blocks after a move of the centroids, or with ``last`` every vector's cluster and distance."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in ("vectors", "kind", "cluster", "keys", "places", "sizes")}
                ids = batch.column("ids")[n].values
                block = Block.read(row, dim)
                change = block.advance(centroids, offsets)
                if last:
                    found = [ids, pa.array(block.cluster), pa.array(block.distances(centroids))]
                    yield pa.RecordBatch.from_arrays(found, names=["vec_id", "cluster", "distance"])
                else:
                    yield block.row(ids, *change)

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long" if last else BLOCK_DDL)


def _changes(blocks: DataFrame, many: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all blocks' changes; one number for each centroid and component comes to the driver."""
    def total(column: str, size: int) -> np.ndarray:
        parts = blocks.select(F.posexplode(column).alias("at", "x")).where("x != 0")
        out = np.zeros(size, object)
        for r in parts.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            out[r["at"]] = int(r["x"])
        return out

    return total("joined", many), total("moved", many * dim).reshape(many, dim)


def cluster_vectors(
    rows: DataFrame, clusters: int = 16, rounds: int = 3, seed: str = "1", dim: int = 64, scale: int = 64,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of every usable vector, and the final centroids as an integer matrix.

    Usable vectors have exactly ``dim`` components, none null or non-finite; a component x counts as the integer
    floor(scale * x), held to 2^40 in either direction. The first centroids are the vectors with the smallest
    sha256 of ``seed:vec_id`` (equal ids: the smaller vector first; null ids last). Each round assigns every
    vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves centroids
    to the floor of their members' mean; a centroid without members stays. A last assignment gives the result.
    It is the plain algorithm's result: bounds only spare distances. ``distance`` is squared, beyond 64 bits the
    largest long. Repeated rows count each by itself; other columns are ignored; with fewer vectors than
    ``clusters`` there are as many centroids as vectors, and an empty table gives no rows.

    The driver holds the centroids only. Every round writes the blocks (vectors in the smallest integer type)
    to the shared folder and deletes the round before.
    """
    vector = F.col(f"`{embedding}`")
    usable = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(F.size(vector) == dim, floors(vector, scale)).alias("ints"))
    kept = stored(usable.where("ints IS NOT NULL"), "integers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "ints").limit(clusters).select("ints").collect()
    centroids = np.array([r["ints"] for r in first], np.int64).reshape(len(first), dim)
    many = len(centroids)
    if not many:
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids
    members, sums, offsets = np.zeros(many, object), np.zeros((many, dim), object), np.zeros(many)
    blocks = stored(_started(kept, centroids), "blocks") if rounds else None
    for n in range(rounds):
        if n:
            following = stored(_advanced(blocks, centroids, offsets, last=False), "blocks")
            drop(blocks)
            blocks = following
        joined, moved = _changes(blocks, many, dim)
        members, sums = members + joined, sums + moved
        before = centroids
        centroids = np.array([[int(s) // int(m) for s in row] if m else old for row, m, old in zip(sums, members, before.tolist())], np.int64)
        drift = np.sqrt(paired_distances(before, centroids).astype(float))
        others = np.array([np.delete(drift, c).max(initial=0) for c in range(many)])
        offsets = (offsets + drift + others) * (1 + CARE)
    if not rounds:
        blocks = stored(_started(kept, centroids), "blocks")
    drop(kept)
    return _advanced(blocks, centroids, offsets, last=True), centroids
