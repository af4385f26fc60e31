"""Periodic runs of words (operator 12): blocks searched for in the windows after them by exact integer convolution.

A run is a stretch of words with a smallest period q (words q apart are the
same), at least max(LEAST, 2 q) long, that no neighbouring word extends.

Block convolution. At scale B (2, 4, 8, …) the words are cut into blocks of B,
and a block is searched for at the distances from 2 B to 4 B - 1 after it (at
the smallest scale from 1 on). Every run with such a period holds a whole
block together with its shifted copy: a run of period q is at least 2 q long,
and q + 2 B - 1 words are enough. The sum of squared differences between a
block and each place of its window comes from a number-theoretic transform of
the word numbers, modulo PRIME; a zero mismatch has the sum zero, so none is
missed. Every distance with sum zero seeds an extension to both sides, which
compares the words themselves: a sum that is zero only modulo PRIME, or a
period that is not the smallest, is refuted there.

Blocks are left out where no run can begin to be found: a pair of words in the
block does not come again within 4 B words, or block and window lie in a known run
of period at most B (a longer smallest period there would contradict that of
the known run, by the theorem of Fine and Wilf). Most text ends there, and a
text of one repeated word needs no quadratic work.

Texts are worked on together, up to about WORDS words at a time, with a word of
its own between two texts, so no run goes over a border. A longer text is worked on
alone; its arrays take some hundred bytes a word.

Cases. Null and empty texts have no words and no run. Repeated rows give
repeated results, an empty table an empty one; other columns are ignored. Ties
for the longest run go to the smallest start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadkin.llm.common import _pieces, texts

LEAST = 12
WORDS = 200_000
PRIME = 2013265921  # 15 * 2^27 + 1
_ROOT = 31  # generates all residues but 0
_CELLS = 1 << 18  # numbers in one transform at a time

_P = np.uint64(PRIME)
_roots: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n / 2 powers of a root of unity of order n, and of its inverse."""
    if n not in _roots:
        pair = []
        for root in (pow(_ROOT, (PRIME - 1) // n, PRIME), pow(_ROOT, PRIME - 1 - (PRIME - 1) // n, PRIME)):
            powers = np.ones(max(1, n // 2), dtype=np.uint64)
            done, step = 1, root
            while done < len(powers):
                powers[done : 2 * done] = powers[:done] * np.uint64(step) % _P
                done, step = 2 * done, step * step % PRIME
            pair.append(powers)
        _roots[n] = tuple(pair)
    return _roots[n]


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order; rows are a power of two long."""
    rows, n = x.shape
    size = n
    while size > 1:
        half = size // 2
        parts = x.reshape(rows, -1, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1]
        out = np.empty_like(parts)
        out[:, :, 0] = (low + high) % _P
        out[:, :, 1] = (low + _P - high) * _powers(size)[0] % _P
        x, size = out.reshape(rows, n), half
    return x


def back(x: np.ndarray) -> np.ndarray:
    """Inverse of `transform`."""
    rows, n = x.shape
    size = 2
    while size <= n:
        half = size // 2
        parts = x.reshape(rows, -1, 2, half)
        low, high = parts[:, :, 0], parts[:, :, 1] * _powers(size)[1] % _P
        out = np.empty_like(parts)
        out[:, :, 0] = (low + high) % _P
        out[:, :, 1] = (low + _P - high) % _P
        x, size = out.reshape(rows, n), 2 * size
    return x * np.uint64(pow(n, PRIME - 2, PRIME)) % _P


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each block and each place of its window: the sum of squared differences modulo PRIME."""
    rows, b = blocks.shape
    places = windows.shape[1] - b + 1
    n = 1 << (windows.shape[1] - 1).bit_length()
    first, second = np.zeros((rows, n), dtype=np.uint64), np.zeros((rows, n), dtype=np.uint64)
    first[:, :b], second[:, : windows.shape[1]] = blocks[:, ::-1], windows
    cross = back(transform(first) * transform(second) % _P)[:, b - 1 : b - 1 + places]
    of_block = (blocks * blocks % _P).sum(axis=1, dtype=np.uint64) % _P
    running = np.concatenate([np.zeros((rows, 1), dtype=np.uint64), np.cumsum(windows * windows % _P, axis=1, dtype=np.uint64)], axis=1)
    of_place = (running[:, b:] - running[:, :-b]) % _P
    return (of_block[:, None] + of_place + (_P - cross) * np.uint64(2)) % _P


def _again(numbers: np.ndarray) -> np.ndarray:
    """How far ahead each pair of neighbouring words comes again (very far: never)."""
    pair = numbers[:-1] * (int(numbers.max()) + 1) + numbers[1:]
    order = np.argsort(pair, kind="stable")
    ahead = np.full(len(pair), np.iinfo(np.int64).max, dtype=np.int64)
    same = pair[order[:-1]] == pair[order[1:]]
    ahead[order[:-1][same]] = np.diff(order)[same]
    return ahead


def _same_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements from the first on are equal."""
    done, step = 0, 16
    while done < len(a):
        off = a[done : done + step] != b[done : done + step]
        if off.any():
            return done + int(off.argmax())
        done, step = done + step, 2 * step
    return len(a)


def extended(words: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """Widest stretch around `start` (start, end) in which words `period` apart are the same."""
    right = _same_for(words[start : len(words) - period], words[start + period :])
    left = _same_for(words[:start][::-1], words[period : start + period][::-1])
    return start - left, start + right + period


def _smaller(words: np.ndarray, start: int, period: int) -> bool:
    """True if a stretch of at least two periods has a smaller one, which then divides it."""
    rest, factor = period, 2
    while rest > 1:
        factor = factor if factor * factor <= rest else rest
        if rest % factor:
            factor += 1
            continue
        while rest % factor == 0:
            rest //= factor
        small = period // factor
        if np.array_equal(words[start : start + period], words[start + small : start + small + period]):
            return True
    return False


def _inside(starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int, int]], most: int) -> np.ndarray:
    """True for stretches that lie in one of the runs of period at most `most`."""
    known = sorted((s, s + n) for s, n, q in runs if q <= most)
    if not known:
        return np.zeros(len(starts), dtype=bool)
    at, reach = np.array([k[0] for k in known]), np.maximum.accumulate([k[1] for k in known])
    place = np.searchsorted(at, starts, side="right") - 1
    return (place >= 0) & (reach[np.maximum(place, 0)] >= ends)


def _seeds(words: np.ndarray, at: np.ndarray, block: int, nearest: int, furthest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (by start) and distances at which they come again; the words have enough padding behind them."""
    width = furthest - nearest + block
    step = max(1, _CELLS // (1 << (width - 1).bit_length()))
    for i in range(0, len(at), step):
        part = at[i : i + step]
        blocks, windows = words[part[:, None] + np.arange(block)], words[part[:, None] + nearest + np.arange(width)]
        row, place = np.nonzero(mismatches(blocks, windows) == 0)
        yield part[row], place + nearest


def runs(numbers: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers (from 1 on), by start, then period."""
    n = len(numbers)
    if n < max(2, least):
        return []
    ahead = _again(numbers)
    words = numbers.astype(np.uint64)
    found: list[tuple[int, int, int]] = []
    block = 2
    # longest period of a run: half of the words; stretches too short for it are left out
    while block == 2 or 2 * block <= n // 2:
        nearest, furthest = (1, 4 * block - 1) if block == 2 else (2 * block, 4 * block - 1)
        at = np.arange(0, n - block + 1, block)
        # all pairs of the block come again soon enough; the last pairs of the text never do
        late = np.concatenate([[0], np.cumsum(ahead >= 4 * block)])
        at = at[late[at + block - 1] == late[at]]
        at = at[~_inside(at, np.minimum(at + furthest + block, n), found, block)]
        padded = np.concatenate([words, np.zeros(furthest + block, dtype=np.uint64)]) if len(at) else words
        reached: dict[int, int] = {}
        for starts, distances in _seeds(padded, at, block, nearest, furthest):
            order = np.lexsort((distances, starts))
            starts, distances = starts[order], distances[order]
            new = ~_inside(starts, starts + distances + block, found, block)
            for x, d in zip(starts[new].tolist(), distances[new].tolist()):
                if x + d + block <= reached.get(d, 0):
                    continue  # part of the stretch that was last found for this distance
                start, end = extended(numbers, x, d)
                if end - start < d + block:
                    continue  # zero only modulo PRIME
                reached[d] = end
                if end - start >= max(least, 2 * d) and not _smaller(numbers, start, d):
                    found.append((start, end - start, d))
        block *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def planted(words: list, doc_id: int | None) -> list:
    """The words with a periodic end, for the documents whose CRC-32 of the id ends in 0."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _together(lists: list[list], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of several texts at once; a number of its own parts two texts."""
    known: dict = {}
    numbers, starts = [], []
    for words in lists:
        starts.append(len(numbers))
        numbers += [known.setdefault(w, len(known)) for w in words]
        numbers.append(known.setdefault((len(starts),), len(known)))  # no word is a tuple
    each: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    at = np.array(starts)
    for start, length, period in runs(np.array(numbers, dtype=np.int64) + 1, least):
        i = int(np.searchsorted(at, start, side="right")) - 1
        each[i].append((start - starts[i], length, period))
    return each


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that repeat the first period of a run."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def find(docs: DataFrame, rewrite=None, least: int = LEAST) -> DataFrame:
    """doc_id, words (joined by a blank, repetitions taken out) and runs (start, length, period) of every whole text.

    `rewrite(words, doc_id)`, if given, changes the words first.
    """
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("runs", run_type)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            held: list[tuple] = []
            n = 0
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = (text or "").encode().split()
                held.append((doc_id, rewrite(words, doc_id) if rewrite else words))
                n += len(words)
                if n >= WORDS or i == batch.num_rows - 1:
                    found = _together([w for _, w in held], least)
                    kept = [b" ".join(collapsed(w, r)).decode() for (_, w), r in zip(held, found)]
                    named = [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in found]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], type=pa.int64()), pa.array(kept), pa.array(named, type=run_type)], schema=schema)
                    held, n = [], 0

    return texts(docs).mapInArrow(each, "doc_id long, text string, runs array<struct<start: long, length: long, period: long>>")


def digests(docs: DataFrame, rewrite=planted, least: int = LEAST) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the text without repetitions."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                best = max(found, key=lambda r: (r["length"], -r["start"], -r["period"]), default=None)
                longest = [best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]] if best else [None] * 4
                lines = "".join([f"{r['start']},{r['length']},{r['period']}\n" for r in found])
                rows.append([doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()])
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in names)
    return find(docs, rewrite, least).mapInArrow(each, kinds)
