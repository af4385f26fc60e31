"""Contact outcomes as a stream into the stored history."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leadkin.sources import history_store
from leadkin.sources.tables import Files


def ingest(
    events: DataFrame,
    path: str,
    checkpoint: str,
    *,
    now: datetime | None = None,
    trigger: dict | None = None,
    **defaults,
) -> StreamingQuery:
    """Add every micro-batch of contact rows; a repeated micro-batch is added once.

    A stream is named by the id that Spark keeps in its checkpoint, so its rows never
    meet those of appends, of other streams into the same history, or of an
    earlier stream whose checkpoint was at the same place.
    `now` fills in rows without a time of their own; left out, it is the time
    of the micro-batch.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        moment = now or datetime.now().astimezone()
        stream = json.loads(Files(rows.sparkSession).read(f"{checkpoint}/metadata"))["id"]
        history_store.add(rows, path, now=moment, key=history_store.stream_key(stream, epoch), **defaults)

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
