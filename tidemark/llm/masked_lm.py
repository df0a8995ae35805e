"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens are the corpus's characters. If there are more than ``CHARACTERS`` of them, the rarer ones are split into their
UTF-8 bytes, so that every character has a probability of its own. The network predicts a token from the ``SIDE``
tokens before it and the ``SIDE`` behind its character; a document's score is the sum of the logarithms of what it
gives to each token. Its training data is the whole corpus, as counts of all windows: these are gathered by one
grouped sum, dealt to a fixed number of shards, and in every round each shard trains on all of its windows,
weighted by their counts, from the network of the round before. The driver averages the shards' networks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_runs, drop, stored, text_arrays

SIDE = 2
BITS = 6
SYMBOLS = 1 << BITS  # 0 is beyond the text's ends, 1 any other character
EDGE, OTHER = 0, 1
# Windows that score texts: characters are numbered from 2, the bytes of rarer ones from BYTES.
WIDE = 9
BYTES = 1 << (WIDE - 1)
CHARACTERS = BYTES - 2
# Least number of shards; there are more where a shard would hold more than SHARD windows, 270 MB.
SHARDS = 64
SHARD = 1 << 24
EMBED, HIDDEN = 10, 40
ROUNDS = 6
BATCH = 512
STEPS = 60  # least steps of a shard in a round: it goes over all its windows as often as that takes
RATE = 0.01
CHUNK = 4 << 20  # bytes of text counted or scored at once


def _characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a stretch of documents, and where each document begins in them (with the end)."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.cumsum(np.concatenate([[0], (raw & 0xC0) != 0x80]))  # bytes that begin a character
    return points, begins[offsets - offsets[0]]


def _stretches(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw, offsets = text_arrays(column)
    for a, b in document_runs(offsets, CHUNK):
        yield _characters(raw[offsets[a] : offsets[b]], offsets[a : b + 1])


def symbol_table(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The most frequent characters of all texts, as code points in the order of their symbols, and the number of symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for points, _ in _stretches(batch.column(0)):
                more = np.bincount(points)
                if len(more) > len(counts):
                    more[: len(counts)] += counts
                    counts = more
                else:
                    counts[: len(more)] += more
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["point", "n"])

    counts = docs.select("text").mapInArrow(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "point").limit(CHARACTERS + 1).collect()
    table = np.array([r["point"] for r in top[:CHARACTERS]], np.int64)
    return table, len(table) + 2 if len(top) <= CHARACTERS else 2 * BYTES


def _symbols(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    lookup = np.full(0x110000, OTHER, np.uint64)
    lookup[table] = np.arange(len(table), dtype=np.uint64) + 2
    return lookup[points]


def _codes(tokens: np.ndarray, begins: np.ndarray, bits: int, more=0) -> np.ndarray:
    """Windows as numbers; ``more`` is how many tokens of the same character come behind a token."""
    sizes = np.diff(begins)
    place = np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)) + 1, sizes) * SIDE
    line = np.zeros(len(tokens) + (len(sizes) + 1) * SIDE, np.uint64)  # EDGE between documents
    line[place] = tokens
    out, last = np.zeros(len(tokens), np.uint64), place + more
    for d in [*range(-SIDE, 0), *range(1, SIDE + 1), 0]:
        out = (out << np.uint64(bits)) | line[(last if d > 0 else place) + d]
    return out


def windows(points: np.ndarray, begins: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For every character its window as one number: the tokens before and behind it, then its own."""
    return _codes(_symbols(points, table), begins, BITS)


def exact_windows(points: np.ndarray, begins: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all tokens, characters beyond ``table`` as their bytes, and where each document begins in them.

    A byte sees the bytes before it but none behind it of its own character, so that the product of their
    probabilities is the character's.
    """
    tokens = _symbols(points, table)
    rare = tokens == OTHER
    if not rare.any():
        return _codes(tokens, begins, WIDE), begins
    lengths = np.where(rare, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(points[rare].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    tokens = np.repeat(tokens, lengths)
    tokens[np.repeat(rare, lengths)] = raw.astype(np.uint64) + np.uint64(BYTES)
    more = np.repeat(ends, lengths) - 1 - np.arange(len(tokens))
    begins = np.concatenate([[0], ends])[begins]
    return _codes(tokens, begins, WIDE, more), begins


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def count_windows(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``(code, n)`` of all windows of all texts; each task sums up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new: list = []
        for batch in batches:
            for points, begins in _stretches(batch.column(0)):
                new.append(np.unique(exact_windows(points, begins, table)[0], return_counts=True))
                if len(new) >= 8:
                    keys, counts = _merged([keys, *(k for k, _ in new)], [counts, *(n for _, n in new)])
                    new = []
                if len(keys) > 6_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["code", "n"])
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if new:
            keys, counts = _merged([keys, *(k for k, _ in new)], [counts, *(n for _, n in new)])
        for a in range(0, len(keys), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].astype(np.int64)), pa.array(counts[part])], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Network:
    """Embeddings of the window's tokens, one hidden layer, a softmax over all tokens."""

    def __init__(self, symbols: int = SYMBOLS, bits: int = BITS, seed: int = 1):
        r = np.random.default_rng(seed)
        self.symbols, self.bits = symbols, bits
        wide = 2 * SIDE * EMBED
        self.weights = [
            r.normal(0, 0.3, (2 * SIDE, symbols, EMBED)), r.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN),
            r.normal(0, HIDDEN**-0.5, (HIDDEN, symbols)), np.zeros(symbols),
        ]
        self.weights = [w.astype(np.float32) for w in self.weights]

    def _token(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Token ``k`` of the windows; the last, ``2 * SIDE``, is the middle one."""
        return (codes.astype(np.int64) >> (self.bits * (2 * SIDE - k))) & ((1 << self.bits) - 1)

    def _forward(self, codes: np.ndarray):
        embed, w1, b1, w2, b2 = self.weights
        around = np.stack([self._token(codes, k) for k in range(2 * SIDE)], 1)
        x = np.concatenate([embed[k][around[:, k]] for k in range(2 * SIDE)], 1)
        h = np.tanh(x @ w1 + b1)
        z = h @ w2 + b2
        z -= z.max(1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
        return around, x, h, log_p

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Logarithm of what the network gives to the middle token of every window."""
        out, step = np.zeros(len(codes)), (1 << 22) // self.symbols
        for a in range(0, len(codes), step):
            part = codes[a : a + step]
            out[a : a + len(part)] = self._forward(part)[3][np.arange(len(part)), self._token(part, 2 * SIDE)]
        return out

    def slopes(self, codes: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradient of the weighted mean of the negative logarithms."""
        _, w1, _, w2, _ = self.weights
        around, x, h, log_p = self._forward(codes)
        dz = np.exp(log_p)
        dz[np.arange(len(codes)), self._token(codes, 2 * SIDE)] -= 1
        dz *= (weight / weight.sum())[:, None].astype(np.float32)
        dh = dz @ w2.T * (1 - h * h)
        dx = dh @ w1.T
        de = np.zeros((2 * SIDE, self.symbols, EMBED), np.float32)
        for k in range(2 * SIDE):
            one = np.zeros((len(codes), self.symbols), np.float32)
            one[np.arange(len(codes)), around[:, k]] = 1
            de[k] = one.T @ dx[:, k * EMBED : (k + 1) * EMBED]
        return [de, x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]

    def train(self, codes: np.ndarray, counts: np.ndarray, rate: float, seed: int) -> None:
        """Whole passes over all windows in random batches, with Adam, until STEPS are done."""
        rng, passes = np.random.default_rng(seed), max(1, -(-STEPS * BATCH // max(1, len(codes))))
        order = np.concatenate([rng.permutation(len(codes)) for _ in range(passes)])
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step, a in enumerate(range(0, len(order), BATCH), 1):
            part = order[a : a + BATCH]
            for w, g, m, v in zip(self.weights, self.slopes(codes[part], counts[part]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def _packed(grams: DataFrame) -> DataFrame:
    """One row per shard with its windows and their counts, sorted; stored, so that rounds shuffle nothing."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code")
        return pd.DataFrame({
            "shard": pdf["shard"].iloc[:1], "tokens": [int(pdf["n"].sum())],
            "codes": [pdf["code"].to_numpy().astype(np.int64).tobytes()], "counts": [pdf["n"].to_numpy().astype(np.int64).tobytes()],
        })

    grams = stored(grams, "grams")
    shards = max(SHARDS, -(-grams.count() // SHARD))
    sharded = grams.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int"))
    rows = sharded.groupBy("shard").applyInPandas(pack, "shard int, tokens long, codes binary, counts binary")
    packed = stored(rows.repartition(shards // 2, "shard"), "windows")
    drop(grams)
    return packed


def train_network(grams: DataFrame, rounds: int = ROUNDS, symbols: int = 2 * BYTES) -> Network:
    """Train on ``grams(code, n)`` in shards; equal counts give equal networks however they are partitioned."""
    spark = grams.sparkSession
    packed, net = _packed(grams), Network(symbols, WIDE)
    for n in range(rounds):
        start = spark.sparkContext.broadcast(net.weights)
        rate = RATE * (1 - 0.8 * n / max(1, rounds - 1))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    own = Network(symbols, WIDE)
                    own.weights = [w.copy() for w in start.value]  # noqa: B023
                    counts = np.frombuffer(r.counts, np.int64).astype(float)
                    own.train(np.frombuffer(r.codes, np.int64), counts, rate, 1000 * n + r.shard)  # noqa: B023
                    flat = np.concatenate([w.ravel() for w in own.weights])
                    yield pd.DataFrame({"shard": [r.shard], "tokens": [r.tokens], "weights": [flat.tobytes()]})

        found = packed.mapInPandas(run, "shard int, tokens long, weights binary").collect()
        found.sort(key=lambda r: r["shard"])
        if not found:
            break
        total = float(sum(r["tokens"] for r in found))
        flat = sum(np.frombuffer(r["weights"], np.float32).astype(float) * (r["tokens"] / total) for r in found)
        ends = np.cumsum([w.size for w in net.weights])
        net.weights = [f.reshape(w.shape).astype(np.float32) for f, w in zip(np.split(flat, ends[:-1]), net.weights)]
    drop(packed)
    return net


def score_documents(docs: DataFrame, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob)`` for every row: the masked pseudo-likelihood of its text.

    The network is trained on all rows' texts. ``n_tokens`` counts characters and ``log_prob`` is the sum over all of
    them, of split ones over their bytes; a null or empty text has none, the sum 0 and no mean. Rows that repeat stay and count each time; other columns are ignored; an
    empty table gives an empty one.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    table, symbols = symbol_table(docs)
    net = train_network(count_windows(docs, table), rounds, symbols)
    shared = docs.sparkSession.sparkContext.broadcast(net.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(symbols, WIDE)
        own.weights = shared.value
        for batch in batches:
            sizes, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            for points, begins in _stretches(batch.column(1)):
                codes, starts = exact_windows(points, begins, table)
                keys = np.unique(codes)
                each = own.log_probabilities(keys)[np.searchsorted(keys, codes)]
                sizes.append(np.diff(begins))
                size = np.diff(starts)
                owner = np.repeat(np.arange(len(size)), size)
                sums.append(np.bincount(owner, weights=each, minlength=len(size)))
            n, s = np.concatenate(sizes), np.concatenate(sums)
            mean = pa.array(s / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s), mean], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, log_prob double, mean_log_prob double")
