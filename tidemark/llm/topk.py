"""Exact top-k search by inner product of integer vectors.

Candidates are dealt to tiles and queries to blocks. A task multiplies a tile with a block as matrices and keeps
the best of the tile for every query by partial selection; a query's lists are merged along a tree of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

TILE = 4096  # candidates of a tile
QUERIES = 2048  # queries of a block
ROWS = 256  # queries multiplied at once
FAN = 8  # lists merged at once
EXACT = 2.0**50  # products below this are exact in doubles and leave room for a place in the tile


def integers(vector: Column | str, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite ones."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # As doubles, for exact products of matrices; components beyond 64 bits become the largest or smallest number.
    return F.when(v.isNotNull() & ~odd, F.transform(v, lambda x: F.rint(F.floor(x.cast("double") * scale).cast("double"))))


def _pack(rows: DataFrame, by: str, into: int) -> DataFrame:
    """One row per group with its ids and its vectors as a matrix, shorter vectors padded with zeros."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        dim = max(1, int(pdf["ints"].map(len).max()))
        matrix = np.zeros((len(pdf), dim))
        for i, v in enumerate(pdf["ints"]):
            matrix[i, : len(v)] = v
        return pd.DataFrame({
            by: pdf[by].iloc[:1], "dim": [dim], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]
        })

    group = F.pmod(F.xxhash64("vec_id", "ints", F.lit(by)), F.lit(into)).cast("int")
    return rows.withColumn(by, group).groupBy(by).applyInPandas(run, f"{by} int, dim int, ids binary, matrix binary")


def best_of(queries, query_ids, tile, tile_ids, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some queries at a time: which queries, ids and scores of their best candidates (ids ascend in the tile)."""
    dim = min(queries.shape[1], tile.shape[1])
    queries, tile = queries[:, :dim], tile[:, :dim]
    most = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * dim
    n = len(tile)
    for at in range(0, len(queries), ROWS):
        ids = query_ids[at : at + ROWS]
        own = ids[:, None] == tile_ids[None, :]
        if most < EXACT:
            score = (queries[at : at + ROWS] @ tile.T).astype(np.int64)
            # One number orders by score and then by place, so the selection has no ties.
            key = np.where(own, np.iinfo(np.int64).min, score * n + (n - 1 - np.arange(n)))
            if n > k:
                pick = np.argpartition(key, n - k, axis=1)[:, n - k :]
            else:
                pick = np.broadcast_to(np.arange(n), key.shape)
            yield ids, np.where(np.take_along_axis(own, pick, 1), -1, pick), np.take_along_axis(score, pick, 1)
        else:
            whole = [[int(x) for x in row] for row in tile.tolist()]
            places, scores = [], []
            for q, mine in zip(queries[at : at + ROWS].tolist(), own):
                q = [int(x) for x in q]
                s = [max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(q, row)))) for row in whole]
                order = sorted((i for i in range(n) if not mine[i]), key=lambda i: (-s[i], i))[:k]
                places.append(order + [-1] * (k - len(order)))
                scores.append([s[i] for i in order] + [0] * (k - len(order)))
            yield ids, np.array(places), np.array(scores, np.int64)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query the ``k`` rows with the highest inner product.

    Components count as floor(64 * x). Queries are the rows for which ``is_query`` (over ``vec_id``) holds;
    candidates are all rows but the query's own; ties go to the smaller id. Vectors that are null or hold null
    or non-finite components, and rows without an id, take no part. Shorter vectors count as padded with zeros.
    Rows with one id and equal vectors are one; with other vectors each is a candidate and, if the id is a query's,
    asks under that id. Scores beyond 64 bits are cut to
    the largest or smallest number. Other columns are ignored; no queries or no candidates give no rows.
    """
    given = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("given")).distinct()
    valid = given.select("vec_id", integers("given").alias("ints")).where("vec_id IS NOT NULL AND ints IS NOT NULL")
    valid = stored(valid, "integers")
    queries = valid.where(is_query)
    total, asked = valid.count(), queries.count()
    tiles, blocks = max(1, -(-total // TILE)), max(1, -(-asked // QUERIES))
    packed = _pack(queries, "block", blocks).select(
        "block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")
    )
    packed = packed.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = _pack(valid, "tile", tiles).join(packed, "tile")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                tile_ids, query_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                tile = np.frombuffer(r.matrix).reshape(len(tile_ids), r.dim)
                queries = np.frombuffer(r.q_matrix).reshape(len(query_ids), r.q_dim)
                for ids, places, scores in best_of(queries, query_ids, tile, tile_ids, k):
                    lists = [
                        [{"s": -s, "id": tile_ids[p]} for p, s in zip(pp, ss) if p >= 0]
                        for pp, ss in zip(places.tolist(), scores.tolist())
                    ]
                    yield pd.DataFrame({"query_id": ids, "part": r.tile, "best": lists})

    # "s" is the score's negative, so that the natural order of (s, id) is that of the ranks.
    kind = "array<struct<s:bigint,id:bigint>>"
    lists = met.select("tile", "dim", "ids", "matrix", "q_dim", "q_ids", "q_matrix").mapInPandas(run, f"query_id long, part int, best {kind}")
    while True:
        tiles = -(-tiles // FAN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("query_id", "part").agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        )
        if tiles <= 1:
            break
    found = lists.select("query_id", F.posexplode("best").alias("place", "b"))
    return found.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score")
    )
