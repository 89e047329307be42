"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document is a histogram of hashed byte trigrams, damped and weighted by inverse document frequency, and beside it a few
shares that a histogram cannot show: of word trigrams and lines that come again, of its most frequent word, and how short it
is. A truncated SVD of the labelled sample spans the latent space. The labelled vectors are broadcast; each block of
documents is multiplied with all of them, and the nearest vote with their cosine as weight.

Defined results: a null or empty text, or one under three bytes, has no vector and gets the training share of
label 1; so does every text when a class has no labels (0 without labels); a null doc_id is not held out; rows
that share a doc_id are scored each on its own; of equally near neighbours the first in doc_id order count;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_column, fresh, mapped, slices, table
from .labelled import ROWS_PER_CLASS, held_out, training_sample

MODULUS, REMAINDER = 4, 2
#: A document is predicted good from this score on.
THRESHOLD = 0.7
#: Hashed features, dimensions of the latent space, voting neighbours, power of the cosine, documents in a block.
FEATURES, RANK, NEIGHBOURS, POWER, BLOCK = 4_096, 48, 41, 4, 256
#: Shares of a text beside its histogram (of unit length), their weight, and the words from which on a text gets less short.
SHARES, SHARE_WEIGHT, SHORT = 4, 0.5, 20


def histogram(text: bytes | None) -> np.ndarray | None:
    """Counts of the hashed byte trigrams of the whole text."""
    if not text or len(text) < 3:
        return None
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    codes = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)


def shares(text: bytes | None) -> np.ndarray:
    """The share of word trigrams found twice or more, of lines equal to an earlier one, of the most frequent word, and shortness."""
    words = text.split() if text else []
    if not words:
        return np.zeros(SHARES, np.float32)
    n = len(words)
    again = sum(c for c in Counter(zip(words, words[1:], words[2:], strict=False)).values() if c > 1) / max(1, n - 2)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return np.array([again, 1 - len(set(lines)) / max(1, len(lines)), max(Counter(words).values()) / n, min(1.0, SHORT / n)], np.float32)


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float):
        self.idf, self.axes, self.vectors, self.labels, self.weights, self.prior = idf, axes, vectors, labels, weights, prior


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped, weighted counts of unit length."""
    x = np.log1p(counts, dtype=np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def features(counts: np.ndarray, idf: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Rows of weighted counts, and the shares beside them, of unit length."""
    return unit(np.concatenate([weigh(counts, idf), SHARE_WEIGHT * beside.astype(np.float32)], axis=1))


def latent_axes(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    probe = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        probe, _ = np.linalg.qr(x.T @ (x @ probe))
    _, _, vt = np.linalg.svd(x @ probe, full_matrices=False)
    return np.ascontiguousarray((probe @ vt.T)[:, :rank])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> Model:
    """Learn from the rows that are not held out, at most `rows` of each class."""
    chosen, sizes = training_sample(docs, labels, "quality", MODULUS, REMAINDER, rows)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            found = [histogram(t) for t in binary_column(batch, "text")]
            packed = [None if h is None else h.astype(np.uint32).tobytes() for h in found]
            beside = [shares(t).tobytes() for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(beside, pa.binary())], names=["doc_id", "label", "counts", "beside"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = mapped(chosen.select("doc_id", "label", "text"), count, f"doc_id {kind}, label int, counts binary, beside binary").filter("counts is not null").collect()
    counted.sort(key=lambda r: (r.doc_id, r.label, bytes(r.counts), bytes(r.beside)))
    y = np.array([r.label for r in counted], np.int8)
    empty = Model(np.zeros(0), np.zeros(0), np.zeros((0, 0)), y[:0], np.zeros(0), prior)
    if not (y == 0).any() or not (y == 1).any():
        return empty
    counts = np.stack([np.frombuffer(r.counts, np.uint32) for r in counted])
    beside = np.stack([np.frombuffer(r.beside, np.float32) for r in counted])
    del counted
    idf = np.log((1 + len(y)) / (1 + (counts > 0).sum(0))).astype(np.float32)
    x = features(counts, idf, beside)
    axes = latent_axes(x, RANK)
    weights = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum()) / total * len(y)
    return Model(idf, axes, unit(x @ axes).astype(np.float32), y, weights.astype(np.float32), prior)


def vote(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """Scores of a block of texts."""
    out = np.full(len(texts), model.prior)
    if not len(model.labels):
        return out
    found = [(i, h) for i, t in enumerate(texts) if (h := histogram(t)) is not None]
    if not found:
        return out
    index = np.array([i for i, _ in found])
    # a block has BLOCK rows always, so that a document's products do not hang on those that share its block
    counts = np.zeros((max(BLOCK, len(found)), FEATURES), np.int64)
    counts[: len(found)] = [h for _, h in found]
    beside = np.zeros((len(counts), SHARES), np.float32)
    beside[: len(found)] = [shares(texts[i]) for i, _ in found]
    latent = unit(features(counts, model.idf, beside) @ model.axes)
    cosines = (latent @ model.vectors.T)[: len(found)]
    k = min(NEIGHBOURS, len(model.labels))
    least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k, None]
    above, tied = cosines > least, cosines == least
    near = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True)))  # of equal ones the first
    weight = np.where(near, np.maximum(cosines, 1e-6) ** POWER * model.weights, 0.0).astype(np.float64)
    out[index] = weight @ model.labels / weight.sum(1)
    return np.clip(out, 0.0, 1.0)


def with_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents' own columns and their score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            scores = pa.array(vote(sent.value, binary_column(batch, "text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, column])

    return mapped(docs, scan, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, with their own columns."""
    name = fresh(docs, "quality_score")
    return with_scores(docs, fit(docs, labels), name).filter(F.col(name) >= THRESHOLD).drop(name)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
