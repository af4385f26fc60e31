"""Language of a text (operator 2): error-correcting output codes over letter n-grams.

Every language has a codeword of +1 and -1. For every bit there is one binary
classifier over hashed letter n-grams (1 to 3 letters): the log ratio of the
mean n-gram distribution of the languages on either side. A text gives one
margin per bit, and the language whose codeword has the smallest weighted
exponential loss wins; bits that tell the training languages apart weakly
weigh less. The score is the winner's share of exp(-loss); a text whose two
best losses are close is flagged as ambiguous.

Training reads rows with a language that the caller has not held out, at most
PER_LANGUAGE rows of each language (in expectation, chosen by a hash of
doc_id). Counts are summed on Spark; the model has languages x BUCKETS numbers.

Cases. A text that is null or has no letter is `und` with score 0. Without any
training row everything is `und`; with one language every text with a letter
gets it with score 1. Repeated rows give repeated results, an empty table an
empty one; other columns are ignored. Whole texts count, of any length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin.llm.common import hash_share, per_text, texts

BUCKETS = 1 << 14
PER_LANGUAGE = 4000
SHARPNESS = 2.0
AMBIGUOUS = 0.5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-letter sequences around each letter; anything else counts as a space."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, dtype=np.uint32)
    padded = np.full(len(code) + 2, 32, dtype=np.uint32)
    padded[1:-1] = np.where(letter, code, 32)
    a, b, c = padded[:-2][letter], padded[1:-1][letter], padded[2:][letter]
    one = b * np.uint32(0x9E3779B1)
    two = (a * np.uint32(0x85EBCA77)) ^ one
    three = (c * np.uint32(0xC2B2AE3D)) ^ two * np.uint32(0x27D4EB2F)
    mixed = np.concatenate([one, two, three])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: all different splits up to five languages, then random ones, far apart."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1)]
        return np.array(splits[1:], dtype=float).T
    bits = int(np.ceil(8 * np.log2(n)))
    best, apart = None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1.0, 1.0)
        distance = (bits - code @ code.T) / 2 + bits * np.eye(n)
        balanced = (np.abs(code.sum(axis=0)) < n).all()
        if balanced and distance.min() > apart:
            best, apart = code, distance.min()
    return best


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BUCKETS, bits)
    trust: np.ndarray  # per bit

    def decide(self, text: str) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        found = grams(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = np.bincount(found, minlength=BUCKETS) @ self.weights / len(found)
        loss = np.exp(-self.code * margin) @ self.trust
        share = np.exp(-SHARPNESS * (loss - loss.min()))
        share /= share.sum()
        first = int(np.argmax(share))
        return self.languages[first], float(share[first]), bool(share[first] < AMBIGUOUS)


def fit(counts: np.ndarray, languages: list[str]) -> Model:
    """From the n-gram counts of each language."""
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 0)), np.zeros(0))
    p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    mean = lambda side: (side.T @ p) / side.sum(axis=0)[:, None]
    weights = np.log(mean((code > 0).astype(float))) - np.log(mean((code < 0).astype(float)))
    expected = code * (p @ weights.T)  # how far each language is on its side of each bit
    scale = np.abs(expected).mean(axis=0)
    trust = np.maximum(expected.min(axis=0) / scale, 0.05)
    return Model(languages, code, np.ascontiguousarray((weights / scale[:, None]).T), SHARPNESS * trust / trust.sum() * len(languages))


def train(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the text and language of rows for which `usable` holds."""
    rows = docs.filter(usable & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    if not sizes:
        return fit(np.zeros((0, BUCKETS)), [])
    languages = [name for name, _ in sizes]
    chosen = [(F.col("lang") == name) & hash_share("doc_id", 11, min(1.0, per_language / n)) for name, n in sizes]
    sample = rows.filter(reduce(lambda a, b: a | b, chosen)).select("lang", "text")
    schema = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = np.bincount(grams(text or ""), minlength=BUCKETS)
                total[lang] = total[lang] + seen if lang in total else seen
        for lang, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), languages.index(lang), dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(seen[at].astype(np.int64))],
                schema=schema,
            )

    summed = sample.mapInArrow(run, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["language"], found["bucket"]] = found["n"]
    return fit(counts, languages)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def rows():
        return Model(*sent.value).decide

    return per_text(texts(docs), "doc_id long, lang_pred string, score double, ambiguous boolean", rows)
