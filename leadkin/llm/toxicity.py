"""Toxicity (operator 9): FTRL-proximal logistic regression over hashed words.

Features of a text: its words, neighbouring pairs and pairs with one word
between, hashed into BUCKETS places, each counted once. Every place has its own
learning rate, and the L1 term keeps most weights at zero, so that what is sent
to the workers is short.

Training reads labelled rows the caller has not held out, at most MAX_TRAIN of
them (in expectation, chosen by a hash of doc_id). The learner goes through
them one by one, in one task that holds only their feature numbers, in an order
that the partitioning cannot change.

Cases. Null text is empty; a text without words gets the score of the bias.
Labels other than 0 and 1 and labels without a document are ignored; of several
labels for one document the highest counts. Without labels every score is 0.
Repeated rows give repeated results, an empty table an empty one; other columns
are ignored. Whole texts count, of any length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin.llm.common import Kept, hash_share, keep_where, per_text, texts

BUCKETS = 1 << 20
MAX_TRAIN = 12000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0

_WORD = re.compile(r"\w+")
_MASK = np.uint64(BUCKETS - 1)


class Features:
    """Text -> different feature numbers; place 0 is the bias."""

    def __init__(self):
        self.codes = Kept(lambda word: zlib.crc32(word.encode()) + 1, 100_000)

    def places(self, text: str) -> np.ndarray:
        words = np.array(list(map(self.codes.__getitem__, _WORD.findall(text.lower()))), dtype=np.uint64)
        near = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        apart = words[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] * np.uint64(3)
        mixed = np.concatenate([words, near, apart]) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(40)) & _MASK).astype(np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(np.append(self.places(text), np.uint32(0)))


class Learner:
    """Follow the proximally regularised leader, one coordinate at a time."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pulled = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -pulled / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _logistic(w.sum()) - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def _logistic(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


class Model(NamedTuple):
    places: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[self.places] = self.weights
        return out


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_train: int = MAX_TRAIN) -> Model:
    """Learn `toxic` from documents whose doc_id satisfies `usable`."""
    told = labels.filter(usable & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    n = told.count()
    if not n:
        return Model(np.empty(0, dtype=np.int64), np.empty(0))
    # at most max_train rows by the choice, so small enough to be sent to the workers
    chosen = told.filter(hash_share("doc_id", 17, min(1.0, max_train / n))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("row"))
    # an id may have many texts, so the rows are bounded once more
    found = sample.select("row").distinct().count()
    sample = sample.filter(hash_share("row", 19, min(1.0, max_train / max(found, 1))))
    kept = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("toxic", pa.int32()), ("places", pa.list_(pa.int32()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Features()
        for batch in batches:
            found = [tool(t or "").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(found, type=pa.list_(pa.int32()))], schema=kept)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            places = batch.column(1)
            flat, ends = places.flatten().to_numpy(), np.cumsum([0, *[len(p) for p in places]])
            rows += [(flat[a:b].copy(), y) for a, b, y in zip(ends, ends[1:], batch.column(0).to_pylist())]
        learner = Learner()
        for _ in range(EPOCHS):
            for at, y in rows:
                learner.learn(at, y)
        weights = learner.weights(slice(None))
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["place", "weight"])

    ordered = (
        sample.mapInArrow(features, "doc_id long, row long, toxic int, places array<int>")
        .dropDuplicates(["doc_id", "row"])
        .repartition(1)
        .sortWithinPartitions(F.xxhash64(F.lit(23), "doc_id"), "doc_id", "places")
    )
    found = ordered.select("toxic", "places").mapInArrow(learn, "place long, weight double").toPandas()
    return Model(found["place"].to_numpy(dtype=np.int64), found["weight"].to_numpy(dtype=float))


def _scorer(parts: tuple):
    """Text -> score, from the parts of a model."""
    known = Model(*parts)
    dense, tool = known.dense(), Features()
    if not len(known.places):
        return lambda text: 0.0
    bias = float(dense[0])

    def each(text: str) -> float:
        at = tool.places(text)
        told = np.unique(at[dense[at] != 0])  # only these can matter
        return _logistic(bias * (0 not in told) + dense[told].sum(dtype=float))

    return each


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def rows():
        each = _scorer(sent.value)
        return lambda text: (each(text),)

    return per_text(texts(docs), "doc_id long, score double", rows)


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def rows():
        each = _scorer(sent.value)
        return lambda batch: [each(text) < limit for text in batch]

    return keep_where(docs, rows)
