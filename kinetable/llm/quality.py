"""Quality classifier: supervised subword embeddings.

Every document is the average of learned vectors of its hashed words, word pairs and character
n-grams (counted over the whole text); a softmax over two classes follows.  The vectors and the
output layer are trained by stochastic gradient descent in numpy, on a bounded sample of labelled
documents (``labels.SAMPLE_PER_CLASS`` a class).  As average and output are linear, scoring adds up
one number for each feature: the product of its vector with the output layer.

Null and empty texts have no features and get the prior; without labels of both classes every
text gets the share of label 1 (0.5 without any).  Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import BYTE_VALUES, encoded, ids_and_text, map_columns, mixed, prefix_sums, range_hashes, rows_where
from kinetable.llm.labels import SAMPLE_PER_CLASS, held_out, training_texts

BUCKET_BITS, DIM, NGRAMS, EPOCHS, RATE = 18, 16, (3, 5), 8, 0.4
TWICE = np.uint64(0xC2B2AE3D27D4EB4F)
LETTER = np.ones(256, bool)
LETTER[[9, 10, 11, 12, 13, 32]] = False


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, and the text each belongs to."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)
    ends = np.cumsum(sizes + 1)
    sums = prefix_sums(BYTE_VALUES[buf])
    inside = LETTER[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, stops = edge[::2], edge[1::2]
    words = range_hashes(sums, starts, stops)
    owner = np.searchsorted(ends, starts, side="right")
    hashes, owners = [words], [owner]
    if len(words) > 1:
        pair = mixed(words[:-1] * np.uint64(3) + words[1:])
        pair[words[:-1] == words[1:]] = TWICE  # one vector for any word said twice
        same = owner[:-1] == owner[1:]
        hashes.append(pair[same])
        owners.append(owner[:-1][same])
    at = np.arange(len(buf))
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    for n in NGRAMS:
        first = at[: max(0, len(buf) - n)]
        first = first[of[first] == of[first + n]]  # the last byte of a text is its end mark
        hashes.append(range_hashes(sums, first, first + n))
        owners.append(of[first])
    h = np.concatenate(hashes)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), np.concatenate(owners).astype(np.int32)


def counted(cols):
    """Sparse counts of each training text, as the bytes of int32 and float32 arrays."""
    buckets, counts = [], []
    for t in encoded(cols["text"]):
        b, n = np.unique(features([t])[0], return_counts=True)
        buckets.append(b.astype(np.int32).tobytes())
        counts.append(n.astype(np.float32).tobytes())
    return {"doc_id": cols["doc_id"], "y": cols["y"], "buckets": buckets, "counts": counts}


def train(rows: list, prior: float, seed: int = 11) -> np.ndarray:
    """One number a bucket (its part of the logit), and the bias as the last entry."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    data = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.float32), int(r["y"])) for r in rows if len(r["buckets"])]
    steps, done = EPOCHS * max(1, len(data)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            b, n, y = data[i]
            share = n / n.sum()
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[b]
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * p[:, None] * hidden
            vectors[b] -= (rate * len(b) ** 0.5) * share[:, None] * back
    weights = np.zeros((1 << BUCKET_BITS) + 1, np.float32)
    weights[:-1] = vectors @ (out[1] - out[0])
    weights[-1] = prior
    return weights


def logits(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    buckets, owner = features(texts)
    n = np.bincount(owner, minlength=len(texts))
    total = np.bincount(owner, weights=weights[buckets].astype(np.float64), minlength=len(texts))
    return total / np.maximum(n, 1) + float(weights[-1])


def probabilities(texts: list, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(encoded(texts), weights), -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> np.ndarray:
    """Weights for ``logits``; the sample is balanced, so the classes' shares come in as the bias."""
    sample, counts = training_texts(docs, labels, "quality", per_class)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    kind = sample.schema["doc_id"].dataType.simpleString()
    sparse = map_columns(sample.select("doc_id", "text", "y"), counted, f"doc_id {kind}, y int, buckets binary, counts binary")
    rows = sorted(sparse.toLocalIterator(), key=lambda r: (r["doc_id"], len(r["buckets"])))
    used = [sum(1 for r in rows if r["y"] == y) for y in (0, 1)]
    if not all(used) or not (n0 and n1):
        weights = np.zeros((1 << BUCKET_BITS) + 1, np.float32)
        weights[-1] = np.log((n1 + 1) / (n0 + 1))
        return weights
    return train(rows, float(np.log(n1 / n0) - np.log(used[1] / used[0])))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(cols):
        return {"doc_id": cols["doc_id"], "score": probabilities(cols["text"], shared.value)}

    rows = ids_and_text(docs)
    scored = map_columns(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """Whole rows whose text scores at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return rows_where(docs, lambda texts: probabilities(texts, shared.value) >= threshold)
