"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents marked as good; the rest of the web text is unlabelled. Plain features of the
whole text go through a small network that minimises the non-negative unbiased risk (Kiryo et al., 2017): the
loss of positives counts with the class prior, and the loss of unlabelled text as negatives, less the part that
positives among it cause, may not fall below zero. The prior is estimated by best-bin estimation (Garg et al.,
2021): where a first classifier ranks texts highest, the ratio of unlabelled to positive ones is at its lowest
and that ratio is the share of positives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of the training sample, by the smallest hashes of the ids.
POSITIVES = 20_000
UNLABELLED = 20_000
HIDDEN = 16
ROUNDS = 60
BATCH = 1024
RATE = 0.01
DECAY = 1e-4
# Characters by kind: lower case, upper case, digits, blanks, line ends, sentence marks, brackets and quotes,
# other ASCII marks, control characters, bytes of other characters.
_KINDS = np.array([
    8 if c < 32 and c not in (9, 10, 13) or c == 127 else 4 if c in (10, 13) else 3 if c in (9, 32)
    else 2 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 0 if 97 <= c <= 122 else 9 if c >= 128
    else 5 if c in b".,;:?!-" else 6 if c in b"()[]{}\"'" else 7 for c in range(256)
])
FEATURES = 28


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; all zero for an empty or null one."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    shares = np.bincount(_KINDS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10) / len(raw)
    n = len(words)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    unlike = len(set(lines)) / len(lines)
    again = sum(map(bytes.__eq__, words[1:], words)) / n
    common = counts.most_common(3)
    lengths = np.fromiter(map(len, words), float, n)
    plain = sum(map(bytes.isalnum, words)) / n
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in counts) / len(counts)
    double = sum(len(w) > 2 and w[-1] == w[-2] and not w[-1:].isalnum() and w[-1] < 128 for w in counts) / len(counts)
    loud = sum(map(bytes.isupper, words)) / n
    titled = sum(w[:1].isupper() for w in words) / n
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
    out[:10] = shares
    out[10:] = [
        1.0, np.log1p(n), np.log1p(len(lines)), np.log1p(n / len(lines)), unlike, again, common[0][1] / n,
        sum(c for _, c in common) / n, len(counts) / n, np.log(len(counts) + 1) / np.log(n + 1), pairs,
        lengths.mean() / 10, lengths.std() / 10, np.log1p(lengths.max()), plain, marked, double + loud, titled * ends,
    ]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    """Network on standardised features; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.hidden(x) @ self.w2 + self.b2)


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> Model:
    """Without a prior, tell positives from unlabelled texts; with one, minimise the non-negative risk."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    d = both.shape[1]
    model = Model(both.mean(0), both.std(0) + 1e-3, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, prior or 0.5)
    state = [np.zeros_like(np.asarray(p, float)) for p in (model.w1, model.b1, model.w2, model.b2)] * 2
    step = 0
    for _ in range(ROUNDS):
        orders = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        batches = max(1, -(-max(len(positive), len(unlabelled)) // BATCH))
        for k in range(batches):
            p, u = (x[o[np.arange(k * BATCH, k * BATCH + min(BATCH, len(o))) % len(o)]] for x, o in zip((positive, unlabelled), orders))
            x = np.concatenate([p, u])
            h = model.hidden(x)
            s = _sigmoid(h @ model.w2 + model.b2)
            sp, su = s[: len(p)], s[len(p) :]
            # Loss -log s for positives and -log(1 - s) for negatives; their slopes in the network's output.
            up, down = (sp - 1) / len(p), sp / len(p)
            if prior is None:
                g = np.concatenate([up, su / len(u)])
            else:
                negative = -np.log(1 - su + 1e-7).mean() + prior * np.log(1 - sp + 1e-7).mean()
                if negative >= 0:
                    g = np.concatenate([prior * up - prior * down, su / len(u)])
                else:  # the estimate has gone below zero: step back from it
                    g = np.concatenate([prior * down, -su / len(u)])
            z = np.clip((x - model.mean) / model.scale, -6, 6)
            gh = g[:, None] * model.w2 * (1 - h * h)
            grads = [z.T @ gh + DECAY * model.w1, gh.sum(0), h.T @ g + DECAY * model.w2, g.sum()]
            step += 1
            for i, (name, grad) in enumerate(zip(("w1", "b1", "w2", "b2"), grads)):
                state[i] = 0.9 * state[i] + 0.1 * grad
                state[4 + i] = 0.999 * state[4 + i] + 0.001 * grad**2
                move = state[i] / (1 - 0.9**step) / (np.sqrt(state[4 + i] / (1 - 0.999**step)) + 1e-8)
                setattr(model, name, getattr(model, name) - RATE * move)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of texts that the classifier was not trained on."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(positive)
    up = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    uu = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((uu + slack) / np.maximum(up, 1e-9))
    return float(np.clip(uu[best] / max(up[best], 1e-9), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 17) -> Model:
    """Estimate the prior on every other text with a classifier of the rest, then train on all."""
    if not len(positive) or not len(unlabelled):
        d = FEATURES
        return Model(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 0.5)
    first = _train(positive[::2], unlabelled[::2], None, seed)
    rest = (positive[1::2], unlabelled[1::2]) if min(len(positive), len(unlabelled)) > 1 else (positive, unlabelled)
    prior = estimate_prior(first.score(rest[0]), first.score(rest[1]))
    return _train(positive, unlabelled, prior, seed)


def _sample(ids: DataFrame, size: int) -> DataFrame:
    """The ids with the smallest hashes; at most ``size`` rows."""
    return ids.distinct().orderBy(F.xxhash64("id", F.lit(11)), "id").limit(size)


def train_quality(docs: DataFrame, positives: DataFrame, positive_limit: int = POSITIVES, unlabelled_limit: int = UNLABELLED) -> Model:
    """Fit on documents ``docs(id, text)``; ``positives(id)`` are trusted.

    The sample is bounded by the two limits and chosen by hashes of ids, so equal tables give equal models. Only
    features of its texts reach the driver. Without positives or documents the model scores 0.5 everywhere.
    """
    known = _sample(positives.where("id IS NOT NULL").select("id"), positive_limit).withColumn("positive", F.lit(True))
    other = _sample(docs.where("id IS NOT NULL").select("id"), unlabelled_limit).withColumn("unlabelled", F.lit(True))
    chosen = known.join(other, "id", "full")
    # At most the two limits of rows: safe to broadcast.
    rows = docs.join(F.broadcast(chosen), "id").select("id", "positive", "unlabelled", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({
                "id": pdf["id"], "positive": pdf["positive"].notna(), "unlabelled": pdf["unlabelled"].notna(),
                "x": [features(t) for t in pdf["text"]],
            })

    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("positive boolean, unlabelled boolean, x array<double>").fields])
    found = rows.mapInPandas(run, schema).toPandas()
    x = np.array(found["x"].tolist()).reshape(-1, FEATURES)
    order = np.lexsort((*x.T[::-1], found["id"].to_numpy()))
    x, positive, unlabelled = x[order], found["positive"].to_numpy()[order], found["unlabelled"].to_numpy()[order]
    return fit(x[positive], x[unlabelled])


def score_quality(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1, higher is better) to every row, from its whole text alone.

    A null text counts as empty and has a score like any other; rows that repeat stay; a column named like the
    new one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.score(np.array([features(t) for t in texts])))

    return docs.withColumn(score, judge(F.col(f"`{text}`")))


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0
