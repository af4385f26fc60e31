"""Benchmark decontamination (operator 4): suffix arrays over shards of documents.

A task cuts its documents into shards of about SHARD_WORDS words. For each
shard it builds a suffix array, sorted by the first WINDOW words, of the
suffixes that can match at all: those whose words follow each other somewhere
in the benchmark for as long as the shortest window. Then the suffixes of the
benchmark items are searched in it by binary search, which gives all places of
every window, and from there the longest verbatim matches.

A window is WINDOW consecutive words of an item, or the whole item if it is
shorter. Documents never leave their task, so a passage that a third of all
documents share is no more work than any other.

The benchmark is read in blocks of at most BLOCK_WORDS words and BLOCK_BYTES (one
item may be more), counted on Spark, each sent to the workers by itself, compressed; the driver
holds one block. A task has one block open at a time, about 250 bytes a word. With several
blocks it gathers up to ROUND_BYTES of documents and takes them through one
block after the other, so a block is compiled once for a round, not for every shard.

Cases. Null text has no words; items without an id or without words take no
part; an item id that occurs several times counts once. Repeated documents
give repeated results; empty tables are fine on either side; other columns are
ignored, or kept unchanged by `clean`. Ties cannot arise.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin.llm.common import texts

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 32 << 20
BLOCK_WORDS = 1 << 20
ROUND_BYTES = 64 << 20
_STEP = 1 << 16
_PAIRS = 1 << 20

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """A-Z in lower case; digits, letters and everything beyond ASCII make words."""
    return text.encode().translate(_WORD_BYTES).split()


class Windows:
    """All different windows of n words of the items that have such, sorted, each with its items.

    Flat arrays, so a block of items takes a small multiple of its text.
    """

    def __init__(self, items: list[np.ndarray], n: int, window: int):
        of = [i for i, x in enumerate(items) if min(window, len(x)) == n]
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(items[i].astype(">u4"), n) for i in of], dtype=">u4")
        keys = np.ascontiguousarray(rows).view(f"S{4 * n}").ravel()
        owner = np.repeat(of, [len(items[i]) - n + 1 for i in of])
        order = np.argsort(keys, kind="stable")  # items stay in order within a window
        keys, owner = keys[order], owner[order]
        new_key = np.append(True, keys[1:] != keys[:-1])
        new = new_key | np.append(True, owner[1:] != owner[:-1])
        self.n, self.window, self.keys, self.items = n, window, keys[new_key], owner[new]
        self.offsets = np.append(np.flatnonzero(new_key[new]), new.sum())

    def within(self, suffixes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, first, end) for every window that some of these sorted suffixes begin with."""
        for at in range(0, len(self.keys), _STEP):
            part = self.keys[at : at + _STEP]
            last = np.full((len(part), 4 * self.window), 0xFF, dtype=np.uint8)  # beyond every suffix that begins with the window
            last[:, : 4 * self.n] = part.view(np.uint8).reshape(-1, 4 * self.n)
            low = np.searchsorted(suffixes, part, side="left")
            high = np.searchsorted(suffixes, last.view(f"S{4 * self.window}").ravel(), side="right")
            for k in np.flatnonzero(high > low):
                yield at + k, low[k], high[k]


class Benchmark:
    """One block of items: numbered words, windows by length, and which items have them."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.names, self.items = [], []
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if ids:
                self.names.append(name)
                self.items.append(np.array(ids, dtype=np.int64))
        self.base = len(self.number) + 1
        pairs = [x[:-1] * self.base + x[1:] for x in self.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
        self.windows = {n: Windows(self.items, n, window) for n in sorted({min(window, len(x)) for x in self.items})}
        self.shortest = min(self.windows, default=0)


class Shard:
    """Documents as one sequence of word numbers (0: not a word of the benchmark, and between documents)."""

    def __init__(self, documents: list[list[bytes]], benchmark: Benchmark):
        self.benchmark = benchmark
        number = benchmark.number
        flat: list[int] = []
        starts = []
        for d in documents:
            starts.append(len(flat))
            flat += [number.get(w, 0) for w in d]
            flat.append(0)
        self.starts = np.array(starts, dtype=np.int64)
        self.ids = np.array(flat + [0] * benchmark.window, dtype=np.int64)
        self._sort()

    def _sort(self) -> None:
        """Suffix array of the suffixes that can match, with their first words as keys."""
        b, ids = self.benchmark, self.ids
        n = len(ids)
        if not b.shortest:
            at = np.empty(0, dtype=np.int64)
        elif b.shortest == 1:
            at = np.flatnonzero(ids)
        else:
            follows = np.zeros(n, dtype=bool)
            known = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            code = ids[known] * b.base + ids[known + 1]
            place = np.minimum(np.searchsorted(b.pairs, code), len(b.pairs) - 1)
            follows[known[b.pairs[place] == code]] = True
            stop = np.flatnonzero(~follows)  # the last word never follows
            start = np.flatnonzero(follows)
            at = start[stop[np.searchsorted(stop, start)] - start >= b.shortest - 1]
        key = ids[at[:, None] + np.arange(b.window)].astype(">u4") if len(at) else np.empty((0, b.window), dtype=">u4")
        keys = np.ascontiguousarray(key).view(f"S{4 * b.window}").ravel()
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def places(self, window: bytes) -> np.ndarray:
        """All places at which the words of a window begin."""
        full = 4 * self.benchmark.window
        low = np.searchsorted(self.keys, np.bytes_(window), side="left")
        high = np.searchsorted(self.keys, np.bytes_(window.ljust(full, b"\xff")), side="right")
        return self.suffixes[low:high]

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """Mask of hit words, and (document, item) pairs as two columns."""
        change = np.zeros(len(self.ids) + 1, dtype=np.int64)
        n_items = max(1, len(self.benchmark.items))
        found, waiting = [np.empty(0, dtype=np.int64)], 0
        for windows in self.benchmark.windows.values() if len(self.suffixes) else ():
            for k, low, high in windows.within(self.keys):
                at = self.suffixes[low:high]
                change[at] += 1  # the places of one window are all different
                change[at + windows.n] -= 1
                document = np.unique(np.searchsorted(self.starts, at, side="right") - 1)
                items = windows.items[windows.offsets[k] : windows.offsets[k + 1]]
                found.append((document[:, None] * n_items + items).ravel())
                waiting += len(found[-1])
                if waiting > _PAIRS:  # neighbouring windows mostly tell the same
                    found, waiting = [np.unique(np.concatenate(found))], 0
        codes = np.unique(np.concatenate(found))
        return np.cumsum(change)[:-1] > 0, np.stack([codes // n_items, codes % n_items], axis=1)

    def longest(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, first word in it, item, first word in it, words) of every match that cannot be extended."""
        b, ids = self.benchmark, self.ids
        for i, x in enumerate(b.items):
            n = min(b.window, len(x))
            raw = x.astype(">u4").tobytes()
            for k in range(len(x) - n + 1):
                for at in self.places(raw[4 * k : 4 * (k + n)]):
                    if k and at and ids[at - 1] == x[k - 1]:
                        continue  # part of a longer match
                    here = ids[at : at + len(x) - k]
                    differs = np.flatnonzero(here != x[k : k + len(here)])
                    document = int(np.searchsorted(self.starts, at, side="right") - 1)
                    yield document, int(at - self.starts[document]), i, k, int(differs[0]) if len(differs) else len(here)


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, block_words: int = BLOCK_WORDS) -> list:
    """Broadcasts of the items, block by block; the driver holds one block at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    send = lambda block: spark.sparkContext.broadcast(zlib.compress(pickle.dumps(block)))
    out, block, size, count = [], [], 0, 0
    for item_id, text, n in items.withColumn("n", F.regexp_count("text", F.lit(_WORD))).toLocalIterator():
        if block and (size + len(text) > block_bytes or count + n > block_words):
            out.append(send(block))
            block, size, count = [], 0, 0
        block.append((item_id, text))
        size += len(text) + 64
        count += n
    return [*out, send(block)]


class _Opened:
    """The blocks of a benchmark in a task; the compiled form of a single block is kept."""

    def __init__(self, blocks: list, window: int):
        self.blocks, self.window, self.single = blocks, window, None

    def __iter__(self) -> Iterator[Benchmark]:
        for block in self.blocks:
            if len(self.blocks) == 1:
                self.single = self.single or self._compiled(block)
                yield self.single
            else:
                yield self._compiled(block)

    def _compiled(self, block) -> Benchmark:
        return Benchmark(pickle.loads(zlib.decompress(block.value)), self.window)

    def rounds(self, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
        """The batches, several together if there are several blocks. `text` is the number of the column of texts."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text).nbytes
            if len(self.blocks) == 1 or size >= ROUND_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)


def _shards(documents: Iterator[str | None]) -> Iterator[list[bytes]]:
    """Documents as bytes in which only words and spaces are left, about SHARD_WORDS words together."""
    shard, n = [], 0
    for text in documents:
        d = (text or "").encode().translate(_WORD_BYTES)
        size = len(d) // 2 + 1 if len(d) < SHARD_WORDS else len(d.split())
        if shard and n + size > SHARD_WORDS:
            yield shard
            shard, n = [], 0
        shard.append(d)
        n += size
    if shard:
        yield shard


def _searched(texts: list[str | None], benchmarks: _Opened) -> Iterator[tuple[int, int, set[str]]]:
    """(words, hit words, items) of every text; each block is opened once."""
    shards = list(_shards(texts))
    hits: list[np.ndarray | None] = [None] * len(shards)
    items = [[set() for _ in shard] for shard in shards]
    for b in benchmarks:
        for s, shard in enumerate(shards):
            mask, pairs = Shard([d.split() for d in shard], b).hits()
            hits[s] = mask if hits[s] is None else hits[s] | mask
            for d, i in pairs.tolist():
                items[s][d].add(b.names[i])
    for shard, hit, found in zip(shards, hits, items):
        before = np.concatenate([[0], np.cumsum(hit)])
        at = 0
        for d, names in zip(shard, found):
            n = len(d.split())
            yield n, int(before[at + n] - before[at]), names
            at += n + 1


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, items (sorted as strings), contaminated."""
    blocks = _blocks(benchmark, block_bytes, block_words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened(blocks, window)
        for some in opened.rounds(batches, 1):
            found = list(_searched(some.column(1).to_pylist(), opened))
            values = [[n for n, _, _ in found], [h for _, h, _ in found], [sorted(i) for _, _, i in found], [h > 0 for _, h, _ in found]]
            yield from pa.table([some.column(0), *[pa.array(c, type=f.type) for c, f in zip(values, list(schema)[1:])]], schema=schema).to_batches()

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = search(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches and where they are: doc_id, doc_word, item_id, item_word, n_words."""
    blocks = _blocks(benchmark)
    schema = pa.schema([("doc_id", pa.int64()), ("doc_word", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened(blocks, window)
        for some in opened.rounds(batches, 1):
            ids, shards = some.column(0).to_pylist(), list(_shards(some.column(1).to_pylist()))
            for b in opened:
                first = 0
                for shard in shards:
                    rows = [(ids[first + d], w, b.names[i], k, n) for d, w, i, k, n in Shard([d.split() for d in shard], b).longest()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)
                    first += len(shard)

    return texts(docs).mapInArrow(run, "doc_id long, doc_word long, item_id string, item_word long, n_words long")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any hit, with all their columns."""
    blocks = _blocks(benchmark, block_words=block_words)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened(blocks, window)
        for some in opened.rounds(batches, at):
            kept = [hit == 0 for _, hit, _ in _searched(some.column(at).to_pylist(), opened)]
            yield from some.filter(pa.array(kept, type=pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)


_SQL_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM items WHERE len(w) > 0
), keys AS (
  SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS key FROM windows
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents
), starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM keys)
), found AS (
  SELECT r, k, s.n, item FROM (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS key FROM starts) s JOIN keys USING (n, key)
), hit AS (
  SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS word FROM found) GROUP BY r
), named AS (
  SELECT r, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
