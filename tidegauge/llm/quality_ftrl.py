"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Tokens are words and runs of symbols with their case. A document's features are hashed unigrams and bigrams of the tokens and
trigrams of their shapes (case, digits, length class, the symbols themselves, whether a token repeats the one before); each
family's counts are divided by its total, so a text's length does not change the scale. Training takes at most
``PER_CLASS`` documents of either class; their sparse vectors pass through the driver, where the updates run one after the
other as the method asks. Scoring is one pass over the texts: the mean of the weights of all features, times a constant,
through the logistic function. Only the weight vector (fixed size) is sent to the tasks.

Defined results: a null or empty text has no feature and gets the score of the bias; equal texts get equal scores; every row
gets one result row; without training rows of both classes the score is the share of class 1, or 0.5; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import words
from tidegauge.llm.samples import training_rows

BITS, PER_CLASS, EPOCHS = 20, 2000, 6
SCALE = 12.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2e-4, 1e-3
FAMILIES = 3


def shapes(w: words.Words) -> np.ndarray:
    """A small hash of each token's look; a symbol run keeps its identity."""
    upper = np.append(0, np.cumsum((w.data >= 0x41) & (w.data <= 0x5A), dtype=np.int32))
    digit = np.append(0, np.cumsum((w.data >= 0x30) & (w.data <= 0x39), dtype=np.int32))
    size = w.ends - w.starts
    ups, nums = upper[w.ends] - upper[w.starts], digit[w.ends] - digit[w.starts]
    first = (upper[np.minimum(w.starts + 1, len(w.data))] - upper[w.starts]) > 0
    look = np.minimum(size, 16) // 4 + 8 * (ups == size) + 16 * (first & (ups < size)) + 32 * (nums > 0) + 64 * (nums == size)
    look = np.where(w.marks, w.hashes, words.mix(look.astype(np.uint64), 5))
    again = np.zeros(len(look), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    return np.where(again, words.mix(look, 6), look)


def features(w: words.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per family: hashed feature numbers of all texts in order, and the texts' bounds among them."""
    mask = np.uint64((1 << BITS) - 1)
    count = np.diff(w.bounds)
    look = shapes(w)
    for family, (base, n) in enumerate(((w.hashes, 1), (w.hashes, 2), (look, 3))):
        marks = words.mix(words.grams(base, n), 100 + family)
        inside = np.maximum(count - n + 1, 0)
        begin = np.append(0, np.cumsum(inside))
        keep = np.arange(begin[-1]) + np.repeat(w.bounds[:-1] - begin[:-1], inside)
        yield (marks[keep] & mask).astype(np.int32), begin


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in words.slices(batch["text"]):
            part = batch.slice(lo, hi - lo)
            made = list(features(words.split(part["text"], marks=True, lower=False)))
            index, value = [], []
            for i in range(part.num_rows):
                at, x = [], []
                for marks, begin in made:
                    own, count = np.unique(marks[begin[i] : begin[i + 1]], return_counts=True)
                    at.append(own)
                    x.append(count / max(1, count.sum()) * (SCALE / FAMILIES))
                index.append(np.concatenate(at))
                value.append(np.concatenate(x).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["y"], pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["doc_id", "y", "index", "value"]
            )


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates in the given order, each class weighing the same in total; the last one is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])
    share = sum(y for _, _, y in examples) / max(1, len(examples))
    if share in (0.0, 1.0):
        out = np.zeros((1 << BITS) + 1)
        out[-1] = 0.0 if not examples else (4.0 if share else -4.0)
        return out

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for index, value, y in examples:
            at, x = np.concatenate([index, bias]), np.append(value, 1.0)
            # features that two families hash to one number are updated once each with the same weight: add them up first
            at, where = np.unique(at, return_inverse=True)
            x = np.bincount(where, x)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x * (0.5 / (share if y else 1 - share))
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - s * w
            n[at] = ni + g * g
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights learnt from labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, "quality", (5, 0), 1, per_class)
    table = rows.mapInArrow(_vector_batches, "doc_id bigint, y int, index array<int>, value array<float>").toArrow()
    order = np.argsort(words.mix(table["doc_id"].to_numpy().astype(np.uint64), 9), kind="stable")
    index, value, y = table["index"].combine_chunks(), table["value"].combine_chunks(), table["y"].to_numpy()
    return ftrl([(index[i].values.to_numpy(), value[i].values.to_numpy().astype(float), int(y[i])) for i in order.tolist()])


def _score_batches(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                dot = np.full(part.num_rows, float(weights[-1]))
                for marks, begin in features(words.split(part["text"], marks=True, lower=False)):
                    total = np.append(0.0, np.cumsum(weights[marks], dtype=np.float64))
                    dot += (total[begin[1:]] - total[begin[:-1]]) / np.maximum(1, np.diff(begin)) * (SCALE / FAMILIES)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(dot, -30, 30))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_score_batches(weights.astype(np.float32)), "doc_id bigint, score double")
