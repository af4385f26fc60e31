"""Latest contact and won flag of every company, kept up by a stream.

Spark's state holds one row per key. A micro-batch stores the rows of the keys it
changed, in a folder named by the stream and its epoch. What is kept only ever
grows (a later contact, a flag once set), so folding such rows gives the same
whatever their order and however often one is there: late events, repeated
micro-batches, a merge that runs twice and several streams into one place do no
harm. Readers fold the stored rows and never see the events.

State grows with the number of keys, not of events. Where keys do not fit into
memory, set Spark's RocksDB provider for its state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leadkin.operators.history import CONTACTS, contacts, folded, layout
from leadkin.sources.tables import Files

MERGE = 32


def ingest(events: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, merge_every: int = MERGE) -> StreamingQuery:
    """Keep what is known of every key up to date with a stream of contact rows; every `merge_every` epochs the stored rows are merged."""

    def write(changed: DataFrame, epoch: int) -> None:
        spark = changed.sparkSession
        stream = json.loads(Files(spark).read(f"{checkpoint}/metadata"))["id"]
        changed.write.mode("overwrite").parquet(f"{path}/{stream}-{epoch:012d}")
        if epoch % merge_every == merge_every - 1:
            compact(spark, path)

    return (
        contacts(layout(events)).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _stored(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], CONTACTS)
    return folded(spark.read.schema(CONTACTS).parquet(*[f"{path}/{name}" for name in folders]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, latest, won: one row per key."""
    return _stored(spark, path, Files(spark).names(path))


def compact(spark: SparkSession, path: str) -> None:
    """One folder instead of many. Old ones go when the new one is whole; unfinished ones are left alone."""
    files = Files(spark)
    whole = [name for name in files.names(path) if files.exists(f"{path}/{name}/_SUCCESS")]
    if len(whole) < 2:
        return
    _stored(spark, path, whole).write.parquet(f"{path}/merged-{uuid.uuid4().hex}")
    for name in whole:
        files.delete(f"{path}/{name}", whole=True)
