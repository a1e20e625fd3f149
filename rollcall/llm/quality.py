"""Quality classifier: supervised subword embeddings.

A document's features are its words (as white space separates them, letter case kept) and the character
n-grams of each word with a mark at both ends. A word pair counts as a feature where both words are the
same; all such pairs share one row, so stuttering is learned once and not per word. Every feature is
hashed to a row of a table of learned vectors; the mean of a document's vectors goes through a linear layer with softmax output. Vectors and
layer are trained by plain stochastic gradient descent in numpy, one document at a time.

Training runs on a sample of labelled rows whose size is a parameter (rows in the order of a hash of
their id), so the model and its training cost are the same at every scale. Scoring reads every whole text.
There the mean of vectors times the layer equals the mean of (vector times layer), so tasks carry one
number per table row, and n-grams are cut once per distinct word of a slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .words import BYTE_VALUES, SMALL_SLICE_BYTES, VISIBLE, find_words, hash_runs, mixed, powers, slices

TRAIN_ROWS = 5_000
BUCKETS = 1 << 17
REPEAT = BUCKETS
DIMENSIONS = 16
GRAMS = (2, 3, 4)
EPOCHS = 6
RATE = 0.25

_U = np.uint64


def _word_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their n-grams, and the number of the word each belongs to."""
    n = len(begin)
    sizes = end - begin
    # All words in a row, each with a byte that texts cannot contain (0xFF) before and after it.
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    spelled = np.full(int(starts[-1]), 255, dtype=np.uint8)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spelled[np.repeat(starts[:-1] + 1, sizes) + inner] = data[np.repeat(begin, sizes) + inner]
    owner = np.repeat(np.arange(n), sizes + 2)
    up, down = powers(len(spelled) + 1)
    sums = np.zeros(len(spelled) + 1, dtype=_U)
    np.cumsum(BYTE_VALUES[spelled] * up[: len(spelled)], out=sums[1:])
    buckets, owners = [hashes % _U(BUCKETS)], [np.arange(n)]
    for size in GRAMS:
        at = np.arange(max(0, len(spelled) - size + 1))
        at = at[owner[at] == owner[at + size - 1]]
        key = mixed((sums[at + size] - sums[at]) * down[at] + _U(size << 32))
        buckets.append(key % _U(BUCKETS))
        owners.append(owner[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _distinct(part) -> tuple:
    """Features of the distinct words of a slice, which distinct word every word is, and whether a
    word repeats the one before it."""
    words = find_words(part.data, part.offsets, VISIBLE)
    hashes = hash_runs(part.data, words.begin, words.end)
    kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    buckets, owners = _word_features(part.data, words.begin[first], words.end[first], kinds)
    again = np.zeros(len(which), dtype=bool)
    again[1:] = which[1:] == which[:-1]
    starts = words.rows[:-1]
    again[starts[starts < len(which)]] = False
    return words, buckets, owners, which, len(kinds), again


class QualityModel:
    """``weights``: what each bucket adds to the logit of label 1, before averaging; ``bias``."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def _document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    column = pa.array([text], pa.large_string())
    part = next(slices(column))
    _, buckets, owners, which, kinds, again = _distinct(part)
    times = np.append(np.bincount(which, minlength=kinds), again.sum())
    rows, place = np.unique(np.append(buckets, REPEAT), return_inverse=True)
    weight = np.bincount(place, weights=times[np.append(owners, kinds)]).astype(np.float32)
    return rows.astype(np.uint32), weight / max(float(weight.sum()), 1.0)


class Features(NamedTuple):
    """Table rows and their shares of all documents end to end; document i has ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    rows: np.ndarray
    shares: np.ndarray


def features_of(texts: list[str | None]) -> Features:
    found = [_document_features(t or "") for t in texts] or [(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.float32))]
    return Features(np.cumsum([0, *(len(r) for r, _ in found)]), np.concatenate([r for r, _ in found]), np.concatenate([w for _, w in found]))


def fit_quality(
    features: Features, labels: list[int], dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1
) -> QualityModel:
    """Trains on the given documents. Without any, or with one label only, the score is the share of label 1."""

    def document(i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(features.starts[i], features.starts[i + 1])
        return features.rows[own], features.shares[own]

    return _trained(document, labels, dimensions, epochs, rate, seed)


def _trained(
    document: Callable[[int], tuple[np.ndarray, np.ndarray]], labels: list[int],
    dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1,
) -> QualityModel:
    """``fit_quality`` on documents whose rows and shares are asked for one at a time."""
    y = np.asarray(labels, dtype=np.float32)
    share = float((y.sum() + 1.0) / (len(y) + 2.0))
    prior = float(np.log(share / (1.0 - share)))
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(np.zeros(BUCKETS + 1, dtype=np.float32), prior)
    draw = np.random.default_rng(seed)
    vectors = np.empty((BUCKETS + 1, dimensions), dtype=np.float32)
    for rows in np.array_split(vectors, 16):
        rows[:] = draw.uniform(-1.0, 1.0, rows.shape)
    vectors /= dimensions
    layer = np.zeros((dimensions, 2), dtype=np.float32)
    bias = np.array([0.0, prior], dtype=np.float32)
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in draw.permutation(len(y)):
            pace = rate * (1.0 - step / steps)
            step += 1
            rows, weight = document(i)
            mean = weight @ vectors[rows] if len(rows) else np.zeros(dimensions, dtype=np.float32)
            logits = mean @ layer + bias
            gradient = np.exp(logits - logits.max())
            gradient /= gradient.sum()
            gradient[int(y[i])] -= 1.0
            back = layer @ gradient
            layer -= pace * np.outer(mean, gradient)
            bias -= pace * 0.1 * gradient
            if len(rows):
                # A row's share of the mean is tiny; the step is scaled by the number of rows.
                vectors[rows] -= (pace * len(rows)) * weight[:, None] * back
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_sample(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", rows: int = TRAIN_ROWS
) -> DataFrame:
    """Packed features and labels of at most ``rows`` labelled texts, the same ones on every run; see ``unpacked``.

    Null labels are ignored, of repeated labels the lowest counts, of repeated ids one text is taken. Features
    are cut in tasks, so a row is bounded by the size of the table, whatever the length of its text.
    """
    judged = labels.filter(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.min(label_column).cast("int").alias("label")
    )
    known = docs.select(F.col(id_column).alias("id")).distinct().join(judged, "id")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    picked = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bodies = [], []
            for text in batch.column("text"):
                rows, shares = _document_features(text.as_py() or "")
                sizes.append(len(rows))
                # Rows ascend and shares repeat, so steps and shares shrink to a third.
                bodies.append(zlib.compress(np.diff(rows, prepend=np.uint32(0)).tobytes() + shares.tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())],
                names=["id", "label", "n", "body"],
            )

    id_type = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(cut, f"id {id_type}, label int, n bigint, body binary")


def unpacked(sample: pd.DataFrame) -> tuple[Features, list[int]]:
    """Features and labels of a training sample in the order of its ids."""
    sample = sample.sort_values("id")
    starts = np.cumsum([0, *sample["n"]])
    features = Features(starts, np.empty(starts[-1], dtype=np.uint32), np.empty(starts[-1], dtype=np.float32))
    for place, (n, packed) in enumerate(zip(sample["n"], sample["body"], strict=True)):
        own = slice(starts[place], starts[place + 1])
        features.rows[own], features.shares[own] = _unpacked_document(n, packed)
    return features, sample["label"].tolist()


def _unpacked_document(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zlib.decompress(packed)
    return np.cumsum(np.frombuffer(body, dtype=np.uint32, count=n), dtype=np.uint32), np.frombuffer(body, dtype=np.float32, offset=4 * n)


def train_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a training sample's rows as one row of weights and bias. Documents are unpacked one at a time."""
    known, sizes, bodies = [], [], []
    for batch in batches:
        known += batch.column("label").to_pylist()
        sizes += batch.column("n").to_pylist()
        bodies += batch.column("body").to_pylist()
    model = _trained(lambda i: _unpacked_document(sizes[i], bodies[i]), known)
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"]
    )


def learn_quality(docs: DataFrame, labels: DataFrame, **columns) -> QualityModel:
    """The model of ``training_sample``, trained in one task.

    Gradient descent goes from document to document, and the sample is bounded, so one task suffices; another
    takes its place if its executor is lost. The task holds the sample packed and unpacks one document at a
    time. Only the finished weights come to the driver.
    """
    sample = training_sample(docs, labels, **columns).repartition(1).sortWithinPartitions("id")
    fitted = sample.mapInArrow(train_packed, "weights binary, bias double").collect()
    if not fitted:
        return fit_quality(features_of([]), [])
    return QualityModel(np.frombuffer(fitted[0]["weights"], dtype=np.float32), fitted[0]["bias"])


def scores_of(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 for every text of a column."""
    scores = np.empty(len(column))
    for part in slices(column, SMALL_SLICE_BYTES):
        words, buckets, owners, which, kinds, again = _distinct(part)
        added = np.bincount(owners, weights=weights[buckets], minlength=kinds)
        parts = np.bincount(owners, minlength=kinds)
        sums = np.concatenate([[0.0], np.cumsum(added[which] + weights[REPEAT] * again)])
        counts = np.concatenate([[0], np.cumsum(parts[which] + again)])
        total = sums[words.rows[1:]] - sums[words.rows[:-1]]
        n = counts[words.rows[1:]] - counts[words.rows[:-1]]
        scores[part.first : part.last] = 1.0 / (1.0 + np.exp(-(total / np.maximum(n, 1) + bias)))
    return scores


def score_quality(docs: DataFrame, model: QualityModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_column``, the probability of label 1.

    Null and empty texts get the model's prior. A column of ``docs`` with the name of the score is replaced.
    """
    docs = docs.drop(score_column)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    names = [*docs.columns, score_column]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = pa.array(scores_of(batch.column(text_column), weights, bias))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=names)

    schema = StructType([*docs.schema.fields, StructField(score_column, DoubleType())])
    return docs.mapInArrow(scored, schema)
