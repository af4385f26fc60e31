"""SimHash near-duplicates (operator 7): fingerprints compared at the anchors of a covering code.

Fingerprint: majority of the 64-bit hashes of all word shingles.

Two fingerprints that differ in at most 3 of 64 bits differ in at most one bit
of bits 0-30 or of bits 31-61. The codewords of the Hamming code of length 31
are the anchors of such a half: it is perfect, so every half lies within the
covering radius 1 of exactly one anchor. A fingerprint goes to every anchor
within radius plus threshold, 1 + 1 = 2 bits: the anchor itself or 1 + 15 of
them. Of two halves that differ in one bit, both reach the anchor next to
either, so no link is lost. Fingerprints are compared only at an anchor.

Equal fingerprints are one row before that, so copies cost nothing. A task
reads its anchors in sorted order, one at a time, and emits at most one link
per fingerprint and anchor (a spanning forest), never all pairs. At an anchor
with very many different fingerprints they are first split by equal quarters
(of four quarters at least one is equal, again without a loss).

Cases. Null and empty text and text of white space have fingerprint 0 and are
linked like any other. Rows with the same doc_id are documents of their own
with one name; a null doc_id can be in a group but never names one if there is
another. Repeated rows, empty tables and other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin.llm.common import per_text, texts
from leadkin.llm.graph import components, least_by
from leadkin.operators.lookup import heavy_light_lookup
from leadkin.session import cut

SHINGLE = 3
BITS = 3
HALF = 31
SEED = 42
CROWDED = 4096
_STEP = 1 << 15

_hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
# the 15 pairs of places that together have the same effect as one place
_PAIRS = np.zeros((HALF + 1, 15), dtype=np.int64)
for _s in range(1, HALF + 1):
    _PAIRS[_s] = [(1 << i - 1) | (1 << j - 1) for i, j in combinations(range(1, HALF + 1), 2) if i ^ j == _s]


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Signed 64-bit number; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    hashes = np.fromiter(map(_hashed, shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within 2 bits of each half: (index of the half, anchor)."""
    syndrome = np.zeros(len(half), dtype=np.int64)
    for i in range(HALF):
        syndrome ^= np.where((half >> i) & 1, i + 1, 0)
    nearest = np.where(syndrome > 0, half ^ (1 << np.maximum(syndrome - 1, 0)), half)
    off = np.flatnonzero(syndrome)
    others = half[off, None] ^ _PAIRS[syndrome[off]]
    index = np.concatenate([np.arange(len(half)), np.repeat(off, 15)])
    return index, np.concatenate([nearest, others.ravel()])


def forest(prints: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all of these different fingerprints within `bits` of each other."""
    if len(prints) > CROWDED:
        for shift in range(0, 64, 16):
            quarter = (prints >> np.uint64(shift)) & np.uint64(0xFFFF)
            order = np.argsort(quarter, kind="stable")
            for part in np.split(prints[order], np.flatnonzero(np.diff(quarter[order])) + 1):
                yield from _spread(part, bits)
    else:
        yield from _spread(prints, bits)


def _spread(rest: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From one fingerprint on to those not reached yet; each is reached once."""
    while len(rest) > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            x = waiting.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                reached = rest[near]
                yield np.full(len(reached), x), reached
                waiting += list(reached)
                rest = rest[~near]


def _at_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().astype(np.int64)
        for at in range(0, len(prints), _STEP):
            part = prints[at : at + _STEP]
            for number in (0, 1):
                index, anchor = anchors((part >> (HALF * number)) & ((1 << HALF) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(anchor | number << HALF), pa.array(part[index])], names=["anchor", "print"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; an anchor may go over several batches."""
    held: list[np.ndarray] = []
    held_key = None

    def out(prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        links = list(forest(prints.view(np.uint64)))
        if links:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, prints = (batch.column(i).to_numpy() for i in (0, 1))
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        if held_key is not None and key[0] != held_key:
            yield from out(np.concatenate(held))
            held = []
        last = len(starts) - 1
        if last == 0:
            held.append(prints.copy())
            held_key = key[0]
            continue
        yield from out(np.concatenate([*held, prints[: ends[0]]]))
        inner = np.flatnonzero(ends[1:last] - starts[1:last] > 1) + 1
        found = [x for i in inner for x in forest(prints[starts[i] : ends[i]].view(np.uint64))]
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        held, held_key = [prints[starts[last] :].copy()], key[-1]
    if held:
        yield from out(np.concatenate(held))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all different fingerprints in column `print` within 3 bits."""
    spread = prints.select("print").mapInArrow(_at_anchors, "anchor long, print long")
    return spread.repartition("anchor").sortWithinPartitions("anchor", "print").mapInArrow(_linked, "a long, b long")


def groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, print, component_id for every row of `docs`."""
    prints = cut(per_text(texts(docs), "doc_id long, print long", lambda: lambda text: (fingerprint(text, size),)))
    different = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(different)).select(F.col("node").alias("print"), "root")
    linked = cut(roots.join(different, "print").select("print", "root", "first"))
    smallest = cut(least_by(linked, "root", "first").withColumnRenamed("least", "component_id"))
    # a root that many different fingerprints have is sent to the workers, so its rows stay where they are
    among = smallest.agg(F.sum("n")).first()[0] or 0
    named = heavy_light_lookup(linked.select("print", "root"), smallest, ["root"], "n", among, F.col("print")).select("print", "component_id")
    named = cut(different.join(named, "print", "left").select("print", F.coalesce("component_id", "first").alias("component_id"), "n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    # the few fingerprints that a large share of all rows can have are sent to the workers, so no task gets all rows of one
    found = heavy_light_lookup(prints, named, ["print"], "n", total, F.xxhash64("doc_id", "print"))
    return found.select("doc_id", "print", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Rows with the same doc_id are one document and stay or go together; it
    stays if any of them names its group. Rows without doc_id stay.
    """
    found = groups(docs, size).filter("doc_id is not null").groupBy("doc_id")
    gone = found.agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone").select("doc_id")
    gone = cut(gone).withColumnRenamed("doc_id", "gone_id")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
