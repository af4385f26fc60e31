"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns; every other column of the input is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def crc_mod(column: str, n: int) -> Column:
    """Remainder of the CRC-32 of a number written as text."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def per_text(df: DataFrame, schema: str, rows: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """One output row per (doc_id, text): doc_id and what the function gives for the text (null: empty).

    `rows` runs once per task and returns the function, so that models are
    opened once and not for every batch.
    """
    out = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows()
        for batch in _pieces(batches):
            values = [each(t or "") for t in batch.column(1).to_pylist()]
            columns = list(zip(*values)) if values else [[] for _ in out.names[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=f.type) for c, f in zip(columns, list(out)[1:])]], schema=out
            )

    return df.select("doc_id", "text").mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
    "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


class Kept(dict):
    """Cache of a function with a bound: at most `limit` recent results and as many of the time before."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def hash_share(column: str, seed: int, rate: float) -> Column:
    """True for about `rate` of the keys, always the same ones; rates may be as small as 2^-63."""
    if rate >= 1:
        return F.lit(True)
    hashed = F.xxhash64(F.lit(seed), F.col(column)).bitwiseAND(F.lit((1 << 63) - 1))
    return hashed < F.lit(max(1, int(rate * (1 << 63))))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def keep_where(docs: DataFrame, rows: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text the function keeps (null: empty)."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows()
        for batch in _pieces(batches):
            yield batch.filter(pa.array(each([t or "" for t in batch.column(at).to_pylist()]), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
