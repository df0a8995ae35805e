"""Clustering and vector codes against the plain algorithms."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, vector_codes, vectors
from tidemark.llm.queries import QUERIES

LONG = (1 << 63) - 1


def whole(x, scale):
    return max(-(1 << 40), min(1 << 40, math.floor(x * scale)))


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def away(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y))


def nearest(x, points):
    return min((away(x, p), n) for n, p in enumerate(points))


def moved(points, assigned, data):
    out = []
    for n, p in enumerate(points):
        own = [x for x, (_, c) in zip(data, assigned) if c == n]
        out.append([sum(col) // len(own) for col in zip(*own)] if own else p)
    return out


def plain_clusters(rows, clusters, rounds, seed, dim, scale):
    kept = [(i, [whole(x, scale) for x in v]) for i, v in rows if usable(v) and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    points, data = [v for _, v in order[:clusters]], [v for _, v in kept]
    for _ in range(rounds):
        points = moved(points, [nearest(x, points) for x in data], data)
    found = [(i, *reversed(nearest(x, points))) for i, x in kept]
    return sorted([(i, c, min(d, LONG)) for i, c, d in found], key=str), points


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [whole(x, scale) for x in v]) for i, v in rows if usable(v)]
    size = max(1, -(-max(len(v) for _, v in kept) // parts))
    kept = [(i, v + [0] * (parts * size - len(v))) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books, codes, errors = [], [[] for _ in kept], [0] * len(kept)
    for p in range(parts):
        points, data = ([v[p * size : (p + 1) * size] for _, v in some] for some in (first, kept))
        for _ in range(rounds):
            points = moved(points, [nearest(x, points) for x in data], data)
        books.append(points)
        for n, x in enumerate(data):
            d, c = nearest(x, points)
            codes[n].append(f"{c:02x}")
            errors[n] += d
    return sorted([(i, "".join(c), min(e, LONG)) for (i, _), c, e in zip(kept, codes, errors)], key=str), books


def table(kind, many=300, dim=8):
    rng = np.random.default_rng(len(kind))
    centres = rng.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] + rng.normal(size=dim) * 0.2).tolist()) for i in range(many)]
    if kind == "ties":  # few different values: many equal distances, repeated vectors
        rows = [(i, rng.integers(-1, 2, dim).astype(float).tolist()) for i in range(many)]
    if kind == "wide":
        rows = [(i, [float(x * 10.0 ** rng.integers(-2, 14)) for x in v]) for i, v in rows]
    odd = [(900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [None] * dim), (905, [float("inf")] * dim),
           (906, [0.0] * dim), (None, [0.5] * dim), (None, [0.25] * dim), (3, rows[3][1]), (3, rows[4][1]), (7, rows[7][1])]
    return rows + odd


def frame(spark, rows, batch=64):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    data = [(i, v, "x", 1.5, i) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, code string, cluster double, ints long").repartition(3)


@pytest.fixture(autouse=True)
def usual_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("kind", ["groups", "ties", "wide"])
def test_clusters_equal_the_plain_algorithm(spark, kind):
    rows = table(kind)
    found, final = centroids.cluster_vectors(frame(spark, rows), clusters=7, rounds=4, seed="s", dim=8, scale=64)
    want, points = plain_clusters(rows, 7, 4, "s", 8, 64)
    assert found.columns == ["vec_id", "cluster", "distance"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == want
    assert final.tolist() == points


@pytest.mark.parametrize("clusters, rounds", [(1, 2), (5, 0), (400, 1)])
def test_few_clusters_and_rounds(spark, clusters, rounds):
    rows = table("groups", 40)
    found, final = centroids.cluster_vectors(frame(spark, rows, 7), clusters=clusters, rounds=rounds, dim=8)
    want, points = plain_clusters(rows, clusters, rounds, "1", 8, 64)
    assert (sorted([tuple(r) for r in found.collect()], key=str), final.tolist()) == (want, points)


def test_no_vectors_to_cluster(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        found, final = centroids.cluster_vectors(frame(spark, rows))
        assert found.count() == 0 and len(final) == 0 and found.columns == ["vec_id", "cluster", "distance"]


def test_bounds_spare_most_distances():
    """Only vectors whose gap has expired are measured again, and the result stays that of full scans."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (8, 16))
    data = centres[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 16))
    points, offsets = data[:8].copy(), np.zeros(8)
    block, scanned = centroids.Block.fresh(data, 8), []
    for _ in range(8):
        *_, again = block.advance(points, offsets)
        scanned.append(again)
        assert (block.cluster == vectors.squared_distances(data, points).argmin(1)).all()
        after = np.array([data[block.cluster == c].mean(0) if (block.cluster == c).any() else points[c] for c in range(8)]).astype(np.int64)
        drift = np.sqrt(((after - points) ** 2).sum(1))
        offsets = offsets + drift + [np.delete(drift, c).max() for c in range(8)]
        points = after
    assert scanned[0] == 4000 and sum(scanned[1:]) < 0.5 * 7 * 4000
    # A block that was written and read again goes on as before.
    row = block.row(pa.array(range(4000)), np.zeros(8, int), np.zeros((8, 16), int), 0).to_pylist()[0]
    again = centroids.Block.read(row, 16)
    assert again.heaps == block.heaps and (again.cluster == block.cluster).all() and (again.vectors == data).all()


@pytest.mark.parametrize("kind", ["groups", "ties", "wide"])
def test_codes_equal_the_plain_algorithm(spark, kind):
    rows = table(kind)
    found, books = vector_codes.compress_vectors(frame(spark, rows), parts=4, entries=70, rounds=3, scale=1024)
    want, points = plain_codes(rows, 4, 70, 3, 1024)
    assert found.columns == ["vec_id", "cluster", "ints", "code", "error"]
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in found.collect()], key=str) == want
    assert books.entries.tolist() == points


def test_vectors_of_odd_lengths(spark):
    rows = [(1, [1.0] * 5), (2, [2.0] * 3), (3, []), (4, [0.5])]
    found, books = vector_codes.compress_vectors(frame(spark, rows), parts=4, entries=3, rounds=2)
    want, points = plain_codes(rows, 4, 3, 2, 1024)
    assert books.dim == 8 and books.entries.tolist() == points
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in found.collect()) == want


def test_no_vectors_to_compress(spark):
    for rows in ([], [(1, None), (2, [None])]):
        found, books = vector_codes.compress_vectors(frame(spark, rows))
        assert found.count() == 0 and books is None and found.columns == ["vec_id", "cluster", "ints", "code", "error"]


def test_empty_tables_give_empty_results(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op11_centroid_clusters"](spark, str(tmp_path)).count() == 0
    assert QUERIES["op12_vector_codes"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("size", [100, 1 << 30])
def test_masks_hold_the_cube_around_a_part(size):
    rng = np.random.default_rng(3)
    entries, x = rng.integers(-size, size, (130, 3)), rng.integers(-size, size, (500, 3))
    book, radius = vector_codes.Codebook(entries), rng.integers(0, size, 500)
    inside = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(2)
    assert (book.candidates(x, radius) == inside).all()
    exact = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    codes, errors = book.nearest(x)
    assert (codes == exact.argmin(1)).all() and (errors == exact.min(1)).all()
    assert all(book.radius(x) ** 2 >= exact.min(1))


def test_labels_meet_in_the_query(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(F.col("label") > 3, F.col("label")))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    labels = {r["vec_id"]: r["label"] for r in rows.collect()}
    sums = {}
    for r in got:
        sums[labels[r["vec_id"]]] = sums.get(labels[r["vec_id"]], 0) + r["error"]
    assert len(got) == len(labels) and all(r["label_error"] == sums[labels[r["vec_id"]]] for r in got) and None in sums
