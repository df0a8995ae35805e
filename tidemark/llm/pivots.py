"""Near-duplicate vectors with a pivot-permutation index.

A vector is described by its nearest reference points (pivots), ordered by nearness. Vectors with a high cosine
have many of them in common, so every three of a vector's nearest pivots make a key of the inverted lists: two
vectors meet if they share at least three. Vectors that meet are verified by their cosine in double precision.
A pair that meets in many lists is counted in one: that of its three smallest common pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import group_starts, stored, whole_groups
from tidemark.llm.components import connected_components

PIVOTS = 1000  # most reference points
SAMPLE = 4000  # bounded sample that they are chosen from: the vectors with the smallest hashes
APART = 0.7  # highest cosine of two pivots: inside a dense group many pivots would have a random order
NEAREST = 10  # pivots that describe a vector
SHARED = 3  # pivots that vectors must have in common to be compared
BLOCK = 512  # members of a list that one step compares with as many others
SMALL = 16  # lists up to this size are compared together, as arrays of pairs


def usable(vector: str = "embedding") -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(f"`{vector}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(rows: DataFrame) -> DataFrame:
    """Equal vectors once: ``(h1, h2, dim, rep, n, vector)``."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    hashed = rows.where(F.col("vec_id").isNotNull() & usable()).select(
        "vec_id", F.col("embedding"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), F.size(v).alias("dim")
    )
    return hashed.groupBy("h1", "h2", "dim").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("vector")
    )


def choose_pivots(units: np.ndarray) -> np.ndarray:
    """Vectors of the sample, one after the other, that are far from all chosen before."""
    chosen = np.zeros((0, units.shape[1]))
    for u in units:
        if len(chosen) < PIVOTS and (not len(chosen) or (chosen @ u).max() < APART):
            chosen = np.vstack([chosen, u])
    return chosen


def _describe(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``(key, h1)`` for every three of the nearest pivots of every vector; keys of other lengths differ."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                points = shared.value.get(int(dim))
                if points is None:
                    continue
                near = nearest(_unit(list(part["vector"])), points)
                take = np.array(list(combinations(range(near.shape[1]), min(SHARED, near.shape[1]))))
                keys = np.full((len(near), len(take)), int(dim), np.int64)
                for column in take.T:
                    keys = keys * (PIVOTS + 1) + near[:, column]
                yield pd.DataFrame({"key": keys.ravel(), "h1": np.repeat(part["h1"].to_numpy(), len(take))})

    return classes.select("h1", "dim", "vector").mapInPandas(run, "key long, h1 long")


def nearest(units: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of every vector, in ascending order."""
    many = min(NEAREST, len(points))
    close = units @ points.T
    picked = np.argsort(-close, axis=1, kind="stable")[:, :many] if len(points) <= 64 else np.argpartition(-close, many - 1, axis=1)[:, :many]
    return np.sort(picked, axis=1)


def _pairs(units, near, keys, x, y, least):
    """Which of the pairs ``x, y`` link, and which of them count in this list."""
    linked = np.einsum("ij,ij->i", units[x], units[y]) >= least
    x, y = x[linked], y[linked]
    base = PIVOTS + 1
    last = (keys[x] % base)[:, None]
    before = ((near[x][:, :, None] == near[y][:, None, :]).any(2) & (near[x] < last)).sum(1)
    return x, y, before == min(SHARED, near.shape[1]) - 1


def _square(units, near, last, one, two, least):
    """The same as matrices for a long list: rows ``one`` against ``two``."""
    linked = units[one] @ units[two].T >= least
    members = np.concatenate([one, two])
    columns = np.unique(near[members])
    columns = columns[columns < last]
    held = np.zeros((len(members), len(columns) + 1), np.float32)
    where = np.searchsorted(columns, near[members])
    held[np.arange(len(members))[:, None], np.where(near[members] < last, where, len(columns))] = 1
    held = held[:, :-1]
    before = held[: len(one)] @ held[len(one) :].T
    return linked, linked & (before == min(SHARED, near.shape[1]) - 1)


class _Tally:
    """Links per member, and pairs that keep linked members together."""

    def __init__(self):
        self.member, self.links, self.a, self.b = [], [], [], []

    def count(self, members, sums):
        hit = np.flatnonzero(sums)
        self.member.append(members[hit])
        self.links.append(sums[hit].astype(np.int64))

    def join(self, a, b):
        self.a.append(a)
        self.b.append(b)

    def frame(self) -> pd.DataFrame:
        none = [np.zeros(0, np.int64)]
        member, links, a, b = (np.concatenate(x or none) for x in (self.member, self.links, self.a, self.b))
        return pd.DataFrame({
            "h1": np.concatenate([member, np.zeros(len(a), np.int64)]),
            "links": np.concatenate([links, np.zeros(len(a), np.int64)]),
            "a": np.concatenate([np.full(len(member), -1), a]), "b": np.concatenate([np.full(len(member), -1), b]),
        })


def _chains(linked: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that join all members of the same component of the matrix, each new member once."""
    open_one, open_two = np.ones(len(one), bool), np.ones(len(two), bool)
    for first in range(len(one)):
        if not open_one[first]:
            continue
        open_one[first] = False
        rows = [first]
        while rows:
            row = rows.pop()
            found = np.flatnonzero(linked[row] & open_two)
            open_two[found] = False
            for c in found:
                yield one[row], two[c]
                back = np.flatnonzero(linked[:, c] & open_one)
                open_one[back] = False
                for r in back:
                    yield one[r], two[c]
                rows += back.tolist()


def _verify(met: DataFrame, pivots: dict[int, np.ndarray], least: float) -> DataFrame:
    """``(h1, links, a, b)``: links to be added up, or (with no links) a pair of linked ids, from sorted lists."""
    shared = met.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["key", "i", "j"]):
            for dim, part in pdf.groupby("dim", sort=False):
                units = _unit(list(part["vector"]))
                near = nearest(units, shared.value[int(dim)])
                reps, weight, keys, ids = (part[c].to_numpy() for c in ("rep", "n", "key", "h1"))
                block, i, j = (part[c].to_numpy() for c in ("block", "i", "j"))
                starts, sizes = group_starts(part, ["key", "i", "j"])
                tally = _Tally()
                for size in np.unique(sizes[sizes <= SMALL]):
                    a, b = np.triu_indices(size, 1)
                    at = starts[sizes == size]
                    x, y = (at[:, None] + a).ravel(), (at[:, None] + b).ravel()
                    across = (i[x] == j[x]) | (block[x] != block[y])
                    x, y, counts = _pairs(units, near, keys, x[across], y[across], least)
                    tally.join(reps[x], reps[y])
                    x, y = np.concatenate([x[counts], y[counts]]), np.concatenate([y[counts], x[counts]])
                    tally.count(ids, np.bincount(x, weights=weight[y], minlength=len(ids)))
                for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
                    here = np.arange(start, start + size)
                    alone = i[start] == j[start]
                    one = here if alone else here[block[here] == i[start]]
                    two = here if alone else here[block[here] == j[start]]
                    if not len(one) or not len(two):
                        continue
                    linked, counts = _square(units, near, keys[start] % (PIVOTS + 1), one, two, least)
                    if alone:
                        np.fill_diagonal(counts, False)
                    else:
                        tally.count(ids[two], weight[one] @ counts)
                    tally.count(ids[one], counts @ weight[two])
                    joined = np.array(list(_chains(linked, one, two)), np.int64).reshape(-1, 2)
                    tally.join(reps[joined[:, 0]], reps[joined[:, 1]])
                yield tally.frame()

    return met.mapInPandas(run, "h1 long, links long, a long, b long")


def near_duplicates(rows: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row, whatever its other columns.

    Vectors link when their cosine is ``least`` or more; ``n_links`` counts the other rows a row links with,
    ``component_id`` is the smallest id that links lead to and ``kept`` tells whether that is the row's own.
    Every vector is indexed; only the pivots are a bounded sample. The search may miss pairs with a cosine just
    above ``least`` (recall about 0.98 at 0.9 in 64 dimensions) and never links pairs below it. Equal vectors are
    one class and always link. Vectors that are null or zero or hold null or non-finite components, and rows
    without an id, link with nothing. Vectors of different lengths do not link. Rows with one id count one by
    one. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    classes = stored(_classes(rows), "vectors")
    pivots: dict[int, np.ndarray] = {}
    for r in classes.select("dim").distinct().collect():  # usually one length
        sample = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("rep", "h1"), "h1").limit(SAMPLE)
        pivots[r["dim"]] = choose_pivots(_unit([v["vector"] for v in sample.select("vector").collect()]))
    keys = stored(_describe(classes, pivots), "keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = keys.join(sizes, "key").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int")
    )
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "h1"
    )
    full = members.join(classes.select("h1", "rep", "n", "dim", "vector"), "h1")
    met = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "h1")
    found = stored(_verify(met, pivots, least), "found")
    counts = found.where("links > 0").groupBy("h1").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links = 0").select("a", "b"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    own = classes.select("h1", "h2", "dim", "rep", "n").join(counts, "h1", "left").join(roots, F.col("rep") == F.col("node"), "left")
    own = own.select(
        "h1", "h2", "dim", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("c")
    )
    keyed = rows.select("vec_id", *[
        F.when(F.col("vec_id").isNotNull() & usable(), x).alias(name)
        for name, x in (("h1", F.xxhash64(v)), ("h2", F.xxhash64(F.lit(1), v)), ("dim", F.size(v)))
    ])
    out = keyed.join(own, ["h1", "h2", "dim"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
