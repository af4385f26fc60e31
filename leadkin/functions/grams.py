"""Character grams of many texts at once, as whole numbers.

A gram is (kind, code, last). The kind says which text field it is of and how long
it is. Two or three letters are 21 bits each of the code, four letters 16 bits each.
Four letters of which any is beyond U+FFFF do not fit: their code holds the first
three and `last` the fourth plus one, which is zero otherwise. So equal numbers are
equal grams, nothing is hashed, and no gram is ever a string.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from leadkin import fixed

SIZES = fixed.GRAM_SIZES
_WHOLE, _PACKED = 21, 16  # bits of a letter
_WIDEST = (1 << _PACKED) - 1


class Grams(NamedTuple):
    """Distinct grams of one kind (code, last), and in which row each is how often."""

    kind: int
    code: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    row: np.ndarray
    tf: np.ndarray


def kind_of(field: int, size: int) -> int:
    return field * len(SIZES) + SIZES.index(size)


def _packed(codes: np.ndarray, at: np.ndarray, letters: int, bits: int) -> np.ndarray:
    key = np.zeros(len(at), dtype=np.uint64)
    for k in range(letters):
        key |= codes[at + k] << np.uint64(bits * k)
    return key.view(np.int64)


def _cells(gram: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cell, tf = np.unique(gram * rows + row, return_counts=True)
    return cell // rows, cell % rows, tf


def grams(texts: list[str], field: int = 0) -> Iterator[Grams]:
    """All grams of all texts; null is empty, and no gram goes from one text into the next."""
    texts = [t or "" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    wide = codes > _WIDEST
    for n in SIZES:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        inside = row[:size] == row[n - 1 :]
        if n * _WHOLE > 64 and wide.any():
            odd = np.logical_or.reduce([wide[k : k + size] for k in range(n)])
            at = np.flatnonzero(inside & odd)
            if len(at):
                both = np.stack([_packed(codes, at, n - 1, _WHOLE), codes[at + n - 1].astype(np.int64) + 1], axis=1)
                known, gram = np.unique(both, axis=0, return_inverse=True)
                yield Grams(kind_of(field, n), known[:, 0], known[:, 1], *_cells(gram.ravel(), row[at], len(texts)))
            inside &= ~odd
        at = np.flatnonzero(inside)
        if len(at):
            known, gram = np.unique(_packed(codes, at, n, _WHOLE if n * _WHOLE <= 64 else _PACKED), return_inverse=True)
            yield Grams(kind_of(field, n), known, np.zeros(len(known), dtype=np.int64), *_cells(gram, row[at], len(texts)))
