"""The best customers of many potentials, exactly, without a cell for every pair.

A component compares one feature of both sides, so its score is worked out once for each pair
of different values. The best values of a component follow from those scores and
from how many customers have each value.

Totals, and sizes, which hardly repeat, are searched in tiles: a tile is a few customers that are
alike. The largest score of each component within a tile bounds the totals in it. Bounds go through the same
operations in the same order as totals do, so a bound is never less than a total of its
tile, ties included. Neighbouring tiles make a group with bounds of its own; a row looks at the tiles of the
groups that may count only. Tiles are opened best first, until no closed one can change the best customers.
Where bounds rule nothing out all pairs are scored, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

TILE = 32
GROUP = 8  # tiles
GROUPS = 8  # groups of which a row sees the tiles before any tile is opened
ROUNDS = (2, 8)  # tiles opened at once, before all others that may count
CELLS = 500_000
FEW = 16  # customers of the same company that are taken out of a list one by one


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's combination of whole numbers, a row that has it, by number)."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        code = np.unique(code * (int(column.max(initial=0)) + 1) + column, return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def largest(scores: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k largest values of each row, largest first, where column c stands for counts[c] equal ones."""
    m = min(k, scores.shape[1])
    at = np.argpartition(-scores, m - 1, axis=1)[:, :m] if m < scores.shape[1] else np.broadcast_to(np.arange(m), scores.shape)
    values = np.take_along_axis(scores, at, axis=1)
    order = np.argsort(-values, axis=1)
    values = np.take_along_axis(values, order, axis=1)
    through = np.cumsum(np.minimum(np.take_along_axis(counts[at], order, axis=1), k), axis=1)
    place = np.zeros((len(scores), k), dtype=np.int64)
    for j in range(k):
        place[:, j] = (through <= j).sum(axis=1)
    return np.take_along_axis(values, np.minimum(place, m - 1), axis=1)


class Same:
    """Customers that are the same company as a potential, by any of several keys; blank keys are no keys."""

    def __init__(self, customers: pd.DataFrame, keys: list[str]):
        self.keys, self.known, self.code, self.rows, self.start, self.count = keys, {}, {}, {}, {}, {}
        for key in keys:
            code, known = pd.factorize(customers[key].replace("", None))
            self.known[key], self.code[key] = pd.Index(known), np.where(code < 0, -2, code)
            self.rows[key] = np.argsort(code, kind="stable")
            self.count[key] = np.bincount(code[code >= 0], minlength=len(known))
            self.start[key] = (code < 0).sum() + np.cumsum(self.count[key]) - self.count[key]

    def codes(self, potentials: pd.DataFrame) -> dict[str, np.ndarray]:
        return {k: self.known[k].get_indexer(potentials[k].replace("", None)) if len(self.known[k]) else np.full(len(potentials), -1) for k in self.keys}

    def of(self, codes: dict[str, np.ndarray], row: np.ndarray, customer: np.ndarray) -> np.ndarray:
        found = np.zeros(len(row), dtype=bool)
        for k in self.keys:
            found |= codes[k][row] == self.code[k][customer]
        return found

    def matches(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        """At least how many there are for each potential; one found by two keys counts twice."""
        return sum(np.where(codes[k] >= 0, np.append(self.count[k], 0)[codes[k]], 0) for k in self.keys)

    def pairs(self, codes: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, customer) of all of them, each once, by row."""
        found = []
        for k in self.keys:
            some = rows[codes[k][rows] >= 0]
            n = self.count[k][codes[k][some]]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[k][codes[k][some]], n)
            found.append(np.stack([np.repeat(some, n), self.rows[k][at]]))
        row, customer = np.unique(np.concatenate(found, axis=1), axis=1)
        return row, customer


class Tiles:
    """Customers in the given order, TILE at a time; no tile goes over from one group into another."""

    def __init__(self, order: np.ndarray, group: np.ndarray, place: np.ndarray):
        group = group[order]
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[begins, len(order)])
        inside = np.arange(len(order)) - np.repeat(begins, sizes)
        first = np.flatnonzero(inside % TILE == 0)
        length = np.diff(np.r_[first, len(order)])
        highest = np.maximum.reduceat(place[order], first)
        by = np.argsort(-highest, kind="stable")
        self.highest = highest[by]
        at = first[by, None] + np.arange(TILE)
        self.members = np.where(np.arange(TILE) < length[by, None], order[np.minimum(at, len(order) - 1)], -1)
        # tiles that follow each other in the given order, by number; the last group may be filled up with -1
        number = np.argsort(by)
        fill = -len(number) % GROUP
        self.groups = np.concatenate([number, np.full(fill, -1)]).reshape(-1, GROUP)
        self.group_members = np.where(self.groups[:, :, None] >= 0, self.members[self.groups], -1).reshape(len(self.groups), -1)

    def values(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different values of each tile, one tile after the other, and where each begins."""
        mine = np.where(self.members >= 0, code[self.members], code[self.members[:, :1]])
        mine = np.sort(mine, axis=1)
        new = np.c_[np.ones(len(mine), dtype=bool), mine[:, 1:] != mine[:, :-1]]
        return mine[new], np.r_[0, np.cumsum(new.sum(axis=1))[:-1]]

    def bounds(self, scores: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The largest score of every tile, for each row of scores by value."""
        value, start = self.values(code)
        step = max(1, CELLS // len(value))
        parts = [np.maximum.reduceat(scores[i : i + step][:, value], start, axis=1) for i in range(0, len(scores), step)]
        return np.concatenate(parts)

    def group_bounds(self, bounds: np.ndarray) -> np.ndarray:
        """The largest bound of every group, for each row of bounds of all tiles."""
        flat = np.where(self.groups >= 0, self.groups, self.groups[:, :1])
        return np.stack([bounds[:, tiles].max(axis=1) for tiles in flat], axis=1)


class Ranges:
    """Least and largest number of each tile or group, to bound the closeness of sizes."""

    def __init__(self, logs: np.ndarray, members: np.ndarray, scale: float):
        here = np.where((members >= 0)[:, :, None], logs[members], np.nan)
        has = np.isfinite(here)
        self.low = np.where(has, here, np.inf).min(axis=1)
        self.high = np.where(has, here, -np.inf).max(axis=1)
        self.some = has.any(axis=1)
        self.all = (has.all(axis=2) | (members < 0)).all(axis=1)
        self.scale = scale

    def bounds(self, logs: np.ndarray, tile: np.ndarray | None = None) -> np.ndarray:
        """Of all tiles for each row, or of the given tiles, some for each row."""
        here = lambda known: known[None] if tile is None else known[tile]
        every, near, has = here(self.all), [], np.isfinite(logs)
        for i in range(logs.shape[1]):
            x = np.where(has[:, i], logs[:, i], 0.0)[:, None]
            gap = np.maximum(np.maximum(here(self.low[:, i]) - x, x - here(self.high[:, i])), 0.0)
            # a little more, as exp need not be monotone to the last bit
            near.append(np.where(has[:, i, None] & here(self.some[:, i]), np.exp(gap / -self.scale) * (1 + 1e-15), 0.0))
        both = has.all(axis=1)[:, None] & every
        return np.where(both, sum(near) / len(near), np.maximum.reduce(near))


def best(
    rows: int,
    tiles: Tiles,
    place: np.ndarray,
    bound: Callable[[np.ndarray, np.ndarray | None], np.ndarray],
    score: Callable[[np.ndarray, np.ndarray], np.ndarray],
    k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(scores, customers) of the k best customers of each row, the higher place first among equals.

    `bound` gives the bounds of all groups for some rows, or those of some tiles for each; `score` the scores
    of some pairs; none is below zero. With fewer than k customers the last scores are -1.
    """
    step = max(1, CELLS // max(len(tiles.members), TILE * sum(ROUNDS)))
    parts = [_best(np.arange(at, min(at + step, rows)), tiles, place, bound, score, k) for at in range(0, rows, step)]
    empty = np.empty((0, k)), np.empty((0, k), dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(empty, *parts))


def _best(row: np.ndarray, tiles: Tiles, place: np.ndarray, bound: Callable, score: Callable, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, line = len(row), np.arange(len(row))[:, None]
    total, who = np.full((n, k), -1.0), np.full((n, k), -1)
    limit, wide = np.full((n, len(tiles.members) + 1), -2.0), bound(row, None)  # a last column for what groups are filled up with

    def look(at: np.ndarray, group: np.ndarray) -> None:
        step = max(1, CELLS // GROUP)
        for i in range(0, len(at), step):
            here, tile = at[i : i + step], tiles.groups[group[i : i + step]]
            limit[here[:, None], tile] = bound(row[here], tile)
        limit[:, -1] = -2.0
        wide[at, group] = -2.0

    first = min(GROUPS, wide.shape[1])
    look(np.repeat(line[:, 0], first), np.argpartition(-wide, first - 1, axis=1)[:, :first].ravel())
    open_now = 0
    for tiles_now in ROUNDS:
        tiles_now = min(tiles_now, len(tiles.members) - open_now)
        if tiles_now <= 0:
            break
        open_now += tiles_now
        chosen, seen = np.empty((n, tiles_now), dtype=np.int64), np.empty((n, tiles_now), dtype=bool)
        for j in range(tiles_now):
            chosen[:, j] = limit.argmax(axis=1)  # the first of equals, which has the highest place
            seen[:, j] = limit[line[:, 0], chosen[:, j]] >= 0
            limit[line[:, 0], chosen[:, j]] = -2.0
        found = tiles.members[chosen].reshape(n, -1)
        value = np.full(found.shape, -1.0)
        real = (found >= 0) & np.repeat(seen, TILE, axis=1)
        value[real] = score(np.broadcast_to(row[:, None], found.shape)[real], found[real])
        found = np.where(real, found, -1)
        total, who = _kept(np.concatenate([total, value], axis=1), np.concatenate([who, found], axis=1), place, k)
    last, last_place = total[:, -1:], np.where(who[:, -1:] >= 0, place[who[:, -1:]], -1)
    look(*np.nonzero(wide >= last))
    at, tile = np.nonzero(limit[:, :-1] >= last)
    may = (limit[at, tile] > last[at, 0]) | (tiles.highest[tile] > last_place[at, 0])
    at, tile = at[may], tile[may]
    step = max(1, CELLS // TILE)
    late: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(at), step):
        found = tiles.members[tile[i : i + step]]
        real = found >= 0
        line_, found = np.broadcast_to(at[i : i + step, None], found.shape)[real], found[real]
        value = score(row[line_], found)
        keep = (value > last[line_, 0]) | ((value == last[line_, 0]) & (place[found] > last_place[line_, 0]))
        late.append(_first(line_[keep], value[keep], found[keep], place, k))
    if late:
        had = np.repeat(np.arange(n), k), total.ravel(), who.ravel()
        line_, value, found = _first(*[np.concatenate(x) for x in zip(had, *late)], place, k)
        total, who = value.reshape(n, k), found.reshape(n, k)
    return total, who


def _kept(value: np.ndarray, found: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((-np.where(found >= 0, place[found], -1), -value), axis=1)[:, :k]
    return np.take_along_axis(value, order, axis=1), np.take_along_axis(found, order, axis=1)


def _first(line: np.ndarray, value: np.ndarray, found: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each line."""
    order = np.lexsort((-np.where(found >= 0, place[found], -1), -value, line))
    line = line[order]
    begins = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, dtype=np.int64)
    inside = np.arange(len(line)) - np.repeat(begins, np.diff(np.r_[begins, len(line)]))
    keep = order[inside < k]
    return line[inside < k], value[keep], found[keep]
