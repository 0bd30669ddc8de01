"""Quality classifier: supervised subword embeddings.

Method: words, pairs of neighbouring words and the character n-grams of words are hashed into buckets; each bucket has a learned vector;
a document is the average of its vectors; a softmax layer gives the probability of each label. All weights are trained by numpy stochastic
gradient descent on the driver, on a bounded sample of labelled rows (``max_train_docs`` and ``max_train_chars``, chosen by the hash of the id). The layer
is linear in the average, so for scoring each bucket is folded to one number (its vector times the difference of the two output
vectors): the model that is broadcast has ``BUCKETS`` floats, whatever the data's size.

Scoring reads every whole text in Arrow batches; the numbers of words are cached within bounds; nothing is shuffled.

Edge cases: null and empty texts have no features and get the prior's score; null ids are not held out and never train; repeated label
rows of one id count once (the smallest label); repeated documents are scored one by one; without any usable label, or with one label
only, the score is the smoothed share of label 1; other columns pass through unless they have an output column's name.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, crc32_mod

BUCKETS = 1 << 18
DIM = 16
NGRAMS = (2, 3)
#: Bounds of the training sample: labelled documents, and characters of their whole texts together.
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 4000, 30_000_000
EPOCHS, RATE, SEED = 8, 1.0, 7
THRESHOLD = 0.7
CACHE_WORDS = 200_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def word_features(word: str) -> list[int]:
    """Buckets of a word: itself and its character n-grams, ends marked. A long word's n-grams are all taken."""
    raw = f"<{word}>"
    return [zlib.crc32(raw.encode("utf-8", "surrogatepass")) % BUCKETS] + [zlib.crc32(raw[i : i + n].encode("utf-8", "surrogatepass"), n) % BUCKETS for n in NGRAMS for i in range(len(raw) - n + 1)]


def pair_features(ids: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words. A word that repeats its neighbour has one bucket of its own kind, whichever word it is."""
    a, b = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
    mixed = (a * _PAIR + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.where(a == b, 0, mixed % np.uint64(BUCKETS)).astype(np.int64)


def document_features(text: str, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts."""
    parts, ids = [], []
    for w in text.split():
        found = cache.get(w)
        if found is None:
            found = cache[w] = np.array(word_features(w), np.int32)
        parts.append(found)
        ids.append(found[0])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, counts = np.unique(np.concatenate([*parts, pair_features(np.array(ids)).astype(np.int32)]), return_counts=True)
    return buckets, counts.astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Folded bucket weights and bias of the log odds of label 1."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    cache: dict = {}
    docs = [document_features(t, cache) for t in texts]
    cache.clear()
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.log([1 - share, share]).astype(np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            rate, done = RATE * (1 - done / steps), done + 1
            buckets, counts = docs[k]
            if not len(buckets):
                continue
            weight = counts / counts.sum()
            mean = weight @ vectors[buckets]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[k]] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= 0.05 * rate * g
            vectors[buckets] -= (rate * len(buckets) ** 0.5) * weight[:, None] * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_train_chars: int = MAX_TRAIN_CHARS) -> tuple[np.ndarray, float]:
    """Train on at most ``max_train_docs`` labelled documents outside the held-out quarter, in the order of the ids' hashes.

    A document that would exceed ``max_train_chars`` in all is passed over; those taken are whole.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", 4) != 2)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs).collect()
    by_id = {int(r["doc_id"]): r["quality"] for r in chosen}
    if not by_id:
        return train([], [])
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    some = lambda ids: F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))  # noqa: E731 - at most max_train_docs rows
    picked = picked.join(some(by_id), "doc_id", "left_semi")
    place = {i: n for n, i in enumerate(by_id)}
    sizes = picked.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).collect()
    fits, total = [], 0
    for r in sorted(sizes, key=lambda r: place[r["doc_id"]]):
        if total + r["n"] <= max_train_chars:
            fits.append(r["doc_id"])
            total += r["n"]
    rows = sorted({(r["doc_id"], r["text"]) for r in picked.join(some(fits), "doc_id", "left_semi").collect()}) if fits else []
    return train([t for _, t in rows], [by_id[i] for i, _ in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 at 0.7 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float64), model[1]))

    def compute(texts: list[str]) -> list[list]:
        weights, bias = shared.value
        cache = compute.__dict__.setdefault("cache", {})
        if len(cache) > CACHE_WORDS:
            cache.clear()
        scores = []
        for text in texts:
            ids, total, n = [], 0.0, 0
            for w in text.split():
                found = cache.get(w)
                if found is None:
                    own = word_features(w)
                    found = (own[0], float(weights[own].sum()), len(own))
                    if len(w) <= 64:
                        cache[w] = found
                ids.append(found[0])
                total += found[1]
                n += found[2]
            if len(ids) > 1:
                total += float(weights[pair_features(np.array(ids))].sum())
                n += len(ids) - 1
            scores.append(float(1 / (1 + np.exp(-(bias + total / max(1, n))))))
        return [scores, [int(s >= THRESHOLD) for s in scores]]

    return append_columns(docs, "text", [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute)
