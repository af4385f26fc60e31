"""Stored contact history: data folders, and a log with one small file per commit.

A writer writes its rows to a folder of its own under `data`, then creates a
file under `log` whose name says all there is to know of the commit: level,
time, rows, folder, key and a fingerprint of what was handed in. A folder
without a log file does not count, so a writer that dies between the two leaves
nothing behind; its repetition writes anew. One listing of `log` tells a
reader which folders to read.

Commits may carry a key. A key that is there already is not written again if
the rows are the same, and refused if they are not, so a repeated write changes
nothing and no write can replace or hide another's rows. Streams use
(stream, epoch), and epochs of a stream grow, so for them one number per stream
is remembered once commits are merged.

Writers merge as they go: FAN commits of a level become one of the next level,
so the log stays short and every row is rewritten a few times only. The
merged commit is logged before those it replaces leave the log. Both at once
do no harm, as rows are reduced to the last of each contact anyway, and data
folders are left alone, so nothing that is being read goes away.

A history in a CSV file is read as it is. The first append takes it over into
a store beside it, the path without `.csv`; the file itself is never changed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import datetime
from typing import NamedTuple
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.operators import history as rules
from leadkin.operators.dedupe import keep_last
from leadkin.sources.tables import Files, exists, read_table

FAN = 32
_FILE = "file"


class Commit(NamedTuple):
    level: int
    time: int
    rows: int
    folder: str
    key: str
    fingerprint: str

    @property
    def name(self) -> str:
        return "~".join([str(self.level), str(self.time), str(self.rows), self.folder, quote(self.key, safe=""), self.fingerprint])

    @classmethod
    def of(cls, name: str) -> "Commit":
        level, moment, rows, folder, key, fingerprint = name.split("~")
        return cls(int(level), int(moment), int(rows), folder, unquote(key), fingerprint)


def _store(path: str) -> tuple[str, str | None]:
    """(folder of the store, CSV file it began with)."""
    return (path[: -len(".csv")], path) if path.lower().endswith(".csv") else (path, None)


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """All commits that count, from one listing."""
    store, _ = _store(path)
    return sorted((Commit.of(n) for n in Files(spark).names(f"{store}/log") if "~" in n and not n.startswith((".", "_"))), key=lambda c: c.time)


def _merged(spark: SparkSession, store: str, found: list[Commit]) -> dict:
    """What merged commits remember: last epoch per stream, fingerprint per other key."""
    streams: dict[str, int] = {}
    keys: dict[str, str] = {}
    for c in found:
        if c.level:
            known = json.loads(Files(spark).read(f"{store}/log/{c.name}"))
            keys |= known["keys"]
            for stream, epoch in known["streams"].items():
                streams[stream] = max(epoch, streams.get(stream, -1))
    return {"streams": streams, "keys": keys}


def stream_key(stream: str, epoch: int) -> str:
    return f"stream {stream} {epoch}"


def _stream_of(key: str) -> tuple[str, int] | None:
    parts = key.split(" ")
    return (parts[1], int(parts[2])) if len(parts) == 3 and parts[0] == "stream" else None


def _stored(spark: SparkSession, store: str, found: list[Commit]) -> DataFrame:
    if not found:
        return rules.empty(spark)
    parts = [f"{store}/data/{c.folder}" for c in found]
    return keep_last(spark.read.schema(rules.SCHEMA).parquet(*parts), fixed.HISTORY_DEDUPE_KEYS, rules.ORDER)


def _taken_over(spark: SparkSession, store: str, found: list[Commit]) -> bool:
    return any(c.key == _FILE for c in found) or _FILE in _merged(spark, store, found)["keys"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Current history; an absent one is empty."""
    store, file = _store(path)
    found = commits(spark, path)
    if file and not _taken_over(spark, store, found) and exists(spark, file):
        return rules.layout(read_table(spark, file))
    return _stored(spark, store, found)


def _checksum(df: DataFrame) -> list:
    """Number of rows and a sum that does not depend on their order."""
    hashed = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns) if c != fixed.ROW_ORD])
    return [F.count(F.lit(1)).alias("rows"), F.sum(hashed.cast("decimal(38,0)")).alias("sum")]


def _fingerprint(rows: int, total) -> str:
    return f"{rows}_{total or 0}"


def _present(spark: SparkSession, store: str, found: list[Commit], key: str, leads: DataFrame) -> bool:
    """True if the key is there with the same rows; other rows under a known key are refused."""
    held = [c.fingerprint for c in found if c.key == key]
    if not held:
        known = _merged(spark, store, found)
        stream = _stream_of(key)
        if stream and stream[1] <= known["streams"].get(stream[0], -1):
            return True  # only the stream itself has this name, and it repeats its own epochs only
        held = [known["keys"][key]] if key in known["keys"] else []
    if not held:
        return False
    if held[0] != _fingerprint(*leads.agg(*_checksum(leads)).first()):
        raise ValueError(f"key {key!r} is taken by other rows")
    return True


def _commit(spark: SparkSession, store: str, commit: Commit, body: dict | None = None) -> None:
    Files(spark).write(f"{store}/log/{commit.name}", json.dumps(body or {}))


def add(leads: DataFrame, path: str, *, now: datetime, run_id: str | None = None, key: str | None = None, **defaults) -> None:
    """Add contacts; the same rows under the same key are added once."""
    spark = leads.sparkSession
    store, file = _store(path)
    found = commits(spark, path)
    if file and not _taken_over(spark, store, found) and exists(spark, file):
        taken = rules.layout(read_table(spark, file))
        folder = uuid.uuid4().hex
        taken.write.parquet(f"{store}/data/{folder}")
        _commit(spark, store, Commit(0, 0, 0, folder, _FILE, ""))
        found = commits(spark, path)
    key = key if key is None or len(key) <= 80 else hashlib.md5(key.encode()).hexdigest()
    if key is not None and _present(spark, store, found, key, leads):
        return
    moment, folder, seen = time.time_ns() // 1000, uuid.uuid4().hex, Observation()
    rows = rules.records(leads.observe(seen, *_checksum(leads)), now=now, run_id=run_id or rules.run_id_of(now), batch=moment, **defaults)
    rules.layout(rows).write.parquet(f"{store}/data/{folder}")
    counted = seen.get
    fingerprint = _fingerprint(counted["rows"], counted["sum"])
    _commit(spark, store, Commit(0, moment, counted["rows"], folder, key or "", fingerprint))
    found.append(Commit(0, moment, counted["rows"], folder, key or "", fingerprint))
    level = 0
    while len(some := [c for c in found if c.level == level]) >= FAN:
        found = [c for c in found if c.level != level] + [_merge(spark, store, some, level + 1)]
        level += 1


def append(leads: DataFrame, path: str, **options) -> DataFrame:
    """Add contacts and return the history with them."""
    add(leads, path, **options)
    return read(leads.sparkSession, path)


def _merge(spark: SparkSession, store: str, some: list[Commit], level: int) -> Commit:
    """One commit in the place of several."""
    known = _merged(spark, store, some)
    for c in some:
        if c.level == 0 and c.key:
            if stream := _stream_of(c.key):
                known["streams"][stream[0]] = max(stream[1], known["streams"].get(stream[0], -1))
            else:
                known["keys"][c.key] = c.fingerprint
    folder = uuid.uuid4().hex
    _stored(spark, store, some).write.parquet(f"{store}/data/{folder}")
    whole = Commit(level, time.time_ns() // 1000, sum(c.rows for c in some), folder, "", "")
    _commit(spark, store, whole, known)
    for c in some:
        Files(spark).delete(f"{store}/log/{c.name}")
    return whole


def compact(spark: SparkSession, path: str) -> None:
    """Merge all commits into one."""
    store, _ = _store(path)
    found = commits(spark, path)
    if len(found) > 1 or any(c.level == 0 for c in found):
        _merge(spark, store, found, 1 + max(c.level for c in found))
