"""Scores of all pairs of potentials and customers, a bounded block at a time.

Every component but the texts is dense, so each potential has to meet each
customer. The pairs are never rows of a DataFrame; only the best values per
potential leave a task. Companies are compared as `nearest` says: components by
their different values, totals and sizes in tiles that bounds rule out. There are
two ways to bring the sides together:

* The customers' features are measured, and if they are small they are sent to
  every worker once. The potentials then stay where they are: no shuffle. Of
  companies, equal vectors of a partition are sent once, and so measured; they may also be
  sent in up to SENT_BLOCKS such blocks, of which a task holds one at a time.
* Otherwise Spark cuts both sides into blocks and shuffles one potential block
  and one customer block to each task. A row weighs what its features take, or
  its share of the most rows a block may have; weights are summed up on Spark,
  and a block is a range of the running sum. So no text makes a block
  larger than the limit and that one text, and blocks weigh the same. For two
  sides of P and C bytes in blocks of p and c, P * C / c + C * P / p bytes are copied, which is
  least for equal blocks: both sides have the same limit. The best values of
  several customer blocks are merged in levels, each of which sees a bounded number of values.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.operators import nearest
from leadkin.session import cut, parallelism

COMPONENTS = list(fixed.COMPONENT_WEIGHTS)
CUSTOMER_BLOCK = 2048
POTENTIAL_BLOCK = 8192
BLOCK_BYTES = 32 * 1024 * 1024
BROADCAST_BYTES = 64 * 1024 * 1024
MERGE_FAN_IN = 64
DENSE = 8
PACKED_ROWS = 2048
PACKED_BYTES = 8 * 1024 * 1024
SENT_BLOCKS = 64
_CELLS = 2_000_000
_GRAMS = 500_000


class GramIndex:
    """The rows of one text field of a customer block, by gram.

    A gram that at least one in DENSE rows has is a row of a full matrix, which takes at most DENSE
    times the room of its entries; products with it are matrix products. All others are lists of rows.
    """

    def __init__(self, grams: list, weights: list):
        lengths = np.array([len(g) for g in grams], dtype=np.int64)
        self.rows = len(grams)
        self.known = np.empty(0, dtype=np.int64)
        if lengths.sum():
            flat = np.concatenate(grams).astype(np.int64)
            order = np.argsort(flat, kind="stable")
            self.row = np.repeat(np.arange(self.rows), lengths)[order]
            self.weight = np.concatenate(weights).astype(float)[order]
            self.known, self.start, self.count = np.unique(flat[order], return_index=True, return_counts=True)
            often = np.flatnonzero(self.count * DENSE >= self.rows)
            self.line = np.full(len(self.known), -1)
            self.line[often] = np.arange(len(often))
            lines = np.repeat(self.line, self.count)
            self.full = np.zeros((len(often), self.rows))
            self.full[lines[lines >= 0], self.row[lines >= 0]] = self.weight[lines >= 0]

    def _often(self, out: np.ndarray, row: np.ndarray, line: np.ndarray, weight: np.ndarray) -> None:
        """Adds the products with the full matrix, a bounded number of given rows at a time; `row` ascends."""
        step = max(1, _CELLS // len(self.full))
        for at in range(0, len(out), step):
            lo, hi = np.searchsorted(row, [at, at + step])
            part = np.zeros((min(step, len(out) - at), len(self.full)))
            part[row[lo:hi] - at, line[lo:hi]] = weight[lo:hi]
            out[at : at + step] += part @ self.full

    def products(self, grams: list, weights: list) -> np.ndarray:
        """Dense (given rows x rows of the block) products."""
        out = np.zeros(len(grams) * self.rows)
        lengths = np.array([len(g) for g in grams], dtype=np.int64)
        if not len(self.known) or not lengths.sum():
            return out.reshape(len(grams), self.rows)
        flat = np.concatenate(grams).astype(np.int64)
        place = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        hit = self.known[place] == flat
        row = np.repeat(np.arange(len(grams)), lengths)[hit]
        weight = np.concatenate(weights).astype(float)[hit]
        place = place[hit]
        line = self.line[place]
        if (line >= 0).any():
            full, rest = line >= 0, line < 0
            self._often(out.reshape(len(grams), self.rows), row[full], line[full], weight[full])
            place, row, weight = place[rest], row[rest], weight[rest]
        first, meets = self.start[place], self.count[place]
        ends = np.cumsum(meets)
        lo, done = 0, 0
        while lo < len(meets):
            # as many grams as meet at most _CELLS customer entries, at least one
            hi = max(int(np.searchsorted(ends, done + _CELLS, side="right")), lo + 1)
            m = meets[lo:hi]
            at = np.arange(m.sum()) + np.repeat(first[lo:hi] - (ends[lo:hi] - m - done), m)
            base = int(row[lo]) * self.rows
            cells = np.repeat(row[lo:hi] * self.rows - base, m) + self.row[at]
            sums = np.bincount(cells, weights=np.repeat(weight[lo:hi], m) * self.weight[at])
            out[base : base + len(sums)] += sums
            lo, done = hi, int(ends[hi - 1])
        return out.reshape(len(grams), self.rows)


class Texts:
    """A customer block of texts, indexed once for all potentials."""

    def __init__(self, c: pd.DataFrame):
        self.rows, self.index = c, GramIndex(c["g_text"].tolist(), c["w_text"].tolist())
        self.step = max(1, _CELLS // max(len(c), 1))


def pieces(p: pd.DataFrame, customers: list) -> Iterator[pd.DataFrame]:
    """Potentials that are scored at once. Of texts, products take many times the room of their grams, so these count too."""
    step = min((c.step for c in customers if c.step), default=max(len(p), 1))
    sizes = p["g_text"].map(len).to_numpy(dtype=np.int64) if "g_text" in p.columns else np.zeros(len(p), dtype=np.int64)
    through, at = np.cumsum(sizes), 0
    while at < len(p):
        limit = (through[at - 1] if at else 0) + _GRAMS
        end = min(at + step, max(int(np.searchsorted(through, limit, side="right")), at + 1))
        yield p.iloc[at:end]
        at = end


def top_values(scores: np.ndarray, k: int = fixed.TOP_VALUES) -> np.ndarray:
    if scores.shape[1] > k:
        scores = -np.partition(-scores, k - 1, axis=1)[:, :k]
    return -np.sort(-scores, axis=1)


def best_columns(total: np.ndarray, order: np.ndarray, k: int = fixed.TOP_MATCHES) -> np.ndarray:
    """Column numbers of the k best cells of each row; the higher row number wins a tie.

    Totals have twelve decimals, so total and place make one whole number.
    """
    n = total.shape[1]
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(order, kind="stable")] = np.arange(n)
    keys = np.rint(total * 1e12).astype(np.int64) * max(n, 1) + place[None, :]
    best = np.argpartition(-keys, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), total.shape)
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(keys, best, axis=1), axis=1), axis=1)


def jaccard(p_mask: np.ndarray, c_mask: np.ndarray) -> np.ndarray:
    """Shared flags as a part of all flags of either row; the flags are bits."""
    p, c = p_mask.astype(np.int64)[:, None], c_mask.astype(np.int64)[None, :]
    return np.bitwise_count(p & c) / np.maximum(np.bitwise_count(p | c), 1)


def _logs(numbers: np.ndarray) -> np.ndarray:
    """log(1 + x); no number where x is absent, negative or infinite."""
    usable = np.isfinite(numbers) & (numbers >= 0)
    return np.where(usable, np.log1p(np.where(usable, numbers, 0.0)), np.nan)


def closeness(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Mean of exp(-|log gap| / scale) over the number columns both rows have."""
    a, b = _logs(p), _logs(c)
    near = np.exp(np.abs(a[:, None, :] - b[None, :, :]) / -fixed.SIZE_SCALE)
    columns = np.isfinite(a).astype(float) @ np.isfinite(b).astype(float).T
    return np.nansum(near, axis=2) / np.maximum(columns, 1.0)


def same(p: pd.Series, c: pd.Series) -> np.ndarray:
    """Equal and not blank."""
    codes, _ = pd.factorize(pd.concat([p, c], ignore_index=True).replace("", None))
    left, right = codes[: len(p)], codes[len(p) :]
    return (left[:, None] == right[None, :]) & (left >= 0)[:, None]


def signal(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    m = fixed.SIGNAL_MATRIX
    with_customer = np.where(c, m["both"], m["potential_only"])[None, :]
    without = np.where(c, m["customer_only"], m["neither"])[None, :]
    return np.where(p[:, None], with_customer, without)


TEXT_FIELDS = ["profile", "welfare", "industry"]
BLOCK_COLUMNS = [
    "id", "company", "name_key", "cust_no", "flags", "employees", "capital", "city", "district", "signal",
    *[f"{kind}_{field}" for field in TEXT_FIELDS for kind in "gw"],
]


Block = dict[str, np.ndarray]


class Packed:
    """Rows of companies, each with the numbers of its text vectors; every different vector is there once."""

    def __init__(self, rows: pd.DataFrame, code: dict[str, np.ndarray], vectors: dict[str, tuple[list, list]]):
        self.rows, self.code, self.vectors = rows, code, vectors

    def plain(self) -> tuple:
        """To be sent: instances of classes of this package may not be, where tasks bring their own copy of it."""
        return self.rows, self.code, self.vectors

    def part(self, at: slice | np.ndarray) -> Packed:
        code, vectors = {}, {}
        for f, (grams, weights) in self.vectors.items():
            used, code[f] = np.unique(self.code[f][at], return_inverse=True)
            vectors[f] = [grams[i] for i in used], [weights[i] for i in used]
        return Packed(self.rows.iloc[at], code, vectors)


def packed(df: pd.DataFrame) -> Packed:
    plain = df[[c for c in df.columns if c[:2] not in ("g_", "w_")]].reset_index(drop=True)
    code, vectors = {}, {}
    for f in TEXT_FIELDS:
        grams, weights = df[f"g_{f}"].tolist(), df[f"w_{f}"].tolist()
        code[f], vectors[f] = _different(grams, weights)
    return Packed(plain, code, vectors)


def _different(grams: list, weights: list) -> tuple[np.ndarray, tuple[list, list]]:
    known: dict[tuple[bytes, bytes], int] = {}
    code = [known.setdefault((g.tobytes(), w.tobytes()), len(known)) for g, w in zip(grams, weights)]
    first = np.unique(code, return_index=True)[1]
    return np.array(code, dtype=np.int64), ([grams[i] for i in first], [weights[i] for i in first])


def merged(parts: list[Packed]) -> Packed:
    code, vectors = {}, {}
    for f in TEXT_FIELDS:
        lists = [sum((p.vectors[f][i] for p in parts), []) for i in (0, 1)]
        number, vectors[f] = _different(*lists)
        before = np.cumsum([0, *[len(p.vectors[f][0]) for p in parts]])
        code[f] = np.concatenate([number[b + p.code[f]] for b, p in zip(before, parts)])
    return Packed(pd.concat([p.rows for p in parts], ignore_index=True), code, vectors)


def _numbers(values: pd.Series) -> np.ndarray:
    return pd.factorize(values.replace("", None))[0] + 1


def _values_of(side: Packed) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each component but size: the number of each row's value, and a row that has it, by number."""
    rows = side.rows
    return {
        "profile": nearest.numbered(side.code["profile"]),
        "welfare": nearest.numbered(side.code["welfare"]),
        "industry": nearest.numbered(rows["flags"].to_numpy(dtype=np.int64), side.code["industry"]),
        "location": nearest.numbered(_numbers(rows["city"]), _numbers(rows["district"])),
        "snack_signal": nearest.numbered(rows["signal"].to_numpy(dtype=np.int64)),
    }


class Companies:
    """A customer block of companies, arranged once for all potentials."""

    def __init__(self, c: Packed):
        self.rows, self.step = c.rows, None
        self.ids = c.rows["id"].to_numpy(dtype=np.int64)
        if not len(self.ids):
            return
        self.company = c.rows["company"].to_numpy(dtype=object)
        self.side, self.values = c, _values_of(c)
        self.index = {f: GramIndex(*c.vectors[f]) for f in TEXT_FIELDS}
        self.same = nearest.Same(c.rows, ["name_key", "cust_no"])
        self.logs = _logs(c.rows[SIZES].to_numpy(dtype=float))
        self.place = np.empty(len(self.ids), dtype=np.int64)
        self.place[np.argsort(self.ids, kind="stable")] = np.arange(len(self.ids))
        has, far = np.isfinite(self.logs), np.where(np.isfinite(self.logs), self.logs, 0.0)
        kind = has[:, 0] * 2 + has[:, 1]
        # strips of the second number, by the first one within a strip
        strip = np.argsort(np.argsort(far[:, 1], kind="stable"), kind="stable") // max(1, math.isqrt(len(far) * nearest.TILE))
        by_size = [-self.place, far[:, 0], np.where(has[:, 1], strip, 0), kind]
        self.by_size = nearest.Tiles(np.lexsort(by_size), kind, np.zeros_like(self.place))
        codes = [self.values[k][0] for k in ("snack_signal", "location", "industry", "profile", "welfare")]
        self.by_total = nearest.Tiles(np.lexsort([*by_size, *codes]), np.zeros_like(self.place), self.place)
        self.sizes = {t: [nearest.Ranges(self.logs, m, fixed.SIZE_SCALE) for m in (t.members, t.group_members)] for t in (self.by_size, self.by_total)}
        self.kind, self.far = kind, np.where(has, self.logs, -np.inf).T.copy()

    def size_bounds(self, tiles: nearest.Tiles, logs: np.ndarray, tile: np.ndarray | None) -> np.ndarray:
        narrow, wide = self.sizes[tiles]
        return wide.bounds(logs) if tile is None else narrow.bounds(logs, tile)

    def scores(self, p: Packed, values: dict) -> dict[str, np.ndarray]:
        """For each component but size: the scores of all different values of both sides."""
        text = {f: i.products(*p.vectors[f]) for f, i in self.index.items()}
        left = lambda k, column: p.rows[column].iloc[values[k][1]].reset_index(drop=True)
        right = lambda k, column: self.rows[column].iloc[self.values[k][1]].reset_index(drop=True)
        here, there = p.code["industry"][values["industry"][1]], self.side.code["industry"][self.values["industry"][1]]
        place = {c: same(left("location", c), right("location", c)) for c in ("city", "district")}
        return {
            "profile": text["profile"],
            "welfare": text["welfare"],
            "industry": fixed.INDUSTRY_MIX["jaccard"] * jaccard(left("industry", "flags").to_numpy(), right("industry", "flags").to_numpy())
            + fixed.INDUSTRY_MIX["text"] * text["industry"][here][:, there],
            "location": fixed.LOCATION_MIX["city"] * place["city"] + fixed.LOCATION_MIX["district"] * place["district"],
            "snack_signal": signal(left("snack_signal", "signal").to_numpy(dtype=bool), right("snack_signal", "signal").to_numpy(dtype=bool)),
        }


SIZES = ["employees", "capital"]


def _total(part: Callable[[str], np.ndarray]) -> np.ndarray:
    total = sum(fixed.COMPONENT_WEIGHTS[k] * part(k) for k in COMPONENTS) / sum(fixed.COMPONENT_WEIGHTS.values())
    return np.round(total, 12)


def _company_block(p: pd.DataFrame, c: Companies) -> Block:
    if not len(c.ids):
        empty = {f"v_{k}": np.empty((len(p), 0)) for k in ("total", *COMPONENTS)}
        best = {f"b_{k}": np.empty((len(p), 0)) for k in ("total", "id", "company", *COMPONENTS)}
        return {"duplicate": np.zeros(len(p), dtype=bool), **empty, **best}
    side = packed(p)
    first, every = _alike(side, c)
    blocks, rest = [], [side.part(first)]
    while rest:
        part = rest.pop()
        values = _values_of(part)
        cells = max(len(values[k][1]) * len(c.values[k][1]) for k in values)
        if cells > 2 * _CELLS and len(part.rows) > 1:
            half = len(part.rows) // 2
            rest += [part.part(slice(half, None)), part.part(slice(0, half))]
        else:
            blocks.append(_companies(part, values, c))
    return {k: np.concatenate([b[k] for b in blocks])[every] for k in blocks[0]}


def _alike(p: Packed, c: Companies) -> tuple[np.ndarray, np.ndarray]:
    """One row of each kind of potentials, and the kind of every row. Potentials that no component tells apart have the same best
    customers, unless one of these is their own company; so a potential that may be a customer is a kind of its own."""
    own = np.where(c.same.matches(c.same.codes(p.rows)) > 0, np.arange(1, len(p.rows) + 1), 0)
    numbers = [pd.factorize(p.rows[n])[0] + 1 for n in SIZES]
    texts = [_numbers(p.rows[n]) for n in ("city", "district")]
    bits = [p.rows[n].to_numpy(dtype=np.int64) for n in ("flags", "signal")]
    every, first = nearest.numbered(own, *p.code.values(), *numbers, *texts, *bits)
    return first, every


def _companies(p: Packed, values: dict, c: Companies) -> Block:
    n, logs = len(p.rows), _logs(p.rows[SIZES].to_numpy(dtype=float))
    k, m = min(fixed.TOP_VALUES, len(c.ids)), min(fixed.TOP_MATCHES, len(c.ids))
    scores = c.scores(p, values)
    bounds = {i: c.by_total.bounds(s, c.values[i][0]) for i, s in scores.items()}
    wide = {i: c.by_total.group_bounds(b) for i, b in bounds.items()}
    codes = c.same.codes(p.rows)
    matches = c.same.matches(codes)
    has = np.isfinite(logs)
    kind, far = has[:, 0] * 2 + has[:, 1], np.where(has, logs, np.inf).T.copy()
    columns = np.array([1.0, 1.0, 1.0, 2.0])  # numbers both have by kind of both; at least one, to divide by

    def near(row: np.ndarray, customer: np.ndarray) -> np.ndarray:
        # a number that is absent is infinitely far, which is no closeness
        gap = sum(np.exp(np.abs(a[row] - b[customer]) / -fixed.SIZE_SCALE) for a, b in zip(far, c.far))
        return gap / columns[kind[row] & c.kind[customer]]

    def part(row: np.ndarray, customer: np.ndarray) -> Callable[[str], np.ndarray]:
        duplicate = np.flatnonzero(matches[row])
        duplicate = duplicate[c.same.of(codes, row[duplicate], customer[duplicate])]

        def of(i: str) -> np.ndarray:
            found = near(row, customer) if i == "size" else scores[i].ravel()[values[i][0][row] * scores[i].shape[1] + c.values[i][0][customer]]
            found[duplicate] = 0.0
            return found

        return of

    def bound(row: np.ndarray, tile: np.ndarray | None) -> np.ndarray:
        of = lambda i: wide[i][values[i][0][row]] if tile is None else bounds[i][values[i][0][row][:, None], tile]
        return _total(lambda i: c.size_bounds(c.by_total, logs[row], tile) if i == "size" else of(i))

    total, who = nearest.best(n, c.by_total, c.place, bound, lambda r, o: _total(part(r, o)), max(k, m))
    size, _ = nearest.best(
        n, c.by_size, np.zeros_like(c.place), lambda r, t: np.round(c.size_bounds(c.by_size, logs[r], t), 12),
        lambda r, o: np.round(part(r, o)("size"), 12), k,
    )
    out = {"duplicate": matches > 0, "v_total": total[:, :k], "b_total": total[:, :m], "b_id": c.ids[who[:, :m]], "b_company": c.company[who[:, :m]]}
    few = c.same.pairs(codes, np.flatnonzero((matches > 0) & (matches <= nearest.FEW)))
    row, customer = np.repeat(np.arange(n), m), who[:, :m].ravel()
    shown = part(row, customer)
    for i in COMPONENTS:
        out[f"b_{i}"] = np.round(shown(i), 12).reshape(n, m)
        out[f"v_{i}"] = size if i == "size" else _top(np.round(scores[i], 12), values[i][0], c.values[i][0], few, k)
    for r in np.flatnonzero(matches > nearest.FEW):
        every = part(np.full(len(c.ids), r), np.arange(len(c.ids)))
        for i in scores:
            out[f"v_{i}"][r] = top_values(np.round(every(i), 12)[None, :], k)[0]
    return out


def _top(scores: np.ndarray, of_row: np.ndarray, of_customer: np.ndarray, zero: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k largest scores of each row over all customers; the pairs in `zero`, at most FEW of a row, count as zero."""
    counts = np.bincount(of_customer, minlength=scores.shape[1])
    out = nearest.largest(scores, counts, k)[of_row]
    row, customer = zero
    if len(row):
        rows, start, line, times = np.unique(row, return_index=True, return_inverse=True, return_counts=True)
        used, of_line = np.unique(of_row[rows], return_inverse=True)
        lists = nearest.largest(scores[used], counts, min(k + nearest.FEW, len(of_customer)))[of_line]
        turn = np.arange(len(row)) - start[line]
        for j in range(times.max()):
            now = turn == j
            hit = lists[line[now]] == scores[of_row[row[now]], of_customer[customer[now]]][:, None]
            found = hit.any(axis=1)
            lists[line[now][found], hit.argmax(axis=1)[found]] = 0.0
        out[rows] = -np.sort(-lists, axis=1)[:, :k]
    return out


def _text_block(p: pd.DataFrame, c: Texts) -> Block:
    total = np.round(c.index.products(p["g_text"].tolist(), p["w_text"].tolist()), 12)
    order = c.rows["id"].to_numpy(dtype=np.int64)
    best = best_columns(total, order)
    rows = np.arange(len(total))[:, None]
    return {
        "duplicate": np.zeros(len(p), dtype=bool), "v_total": top_values(total), "b_total": total[rows, best],
        "b_id": order[best], "b_company": c.rows["company"].to_numpy(dtype=object)[best],
    }


def _joined(blocks: list[Block]) -> Block:
    """Best values of the same potentials over several customer blocks."""
    if len(blocks) == 1:
        return blocks[0]
    whole = {k: np.concatenate([b[k] for b in blocks], axis=1) for k in blocks[0] if k != "duplicate"}
    order = np.lexsort((-whole["b_id"], -whole["b_total"]), axis=1)[:, : fixed.TOP_MATCHES]
    out = {k: top_values(v) if k.startswith("v_") else np.take_along_axis(v, order, axis=1) for k, v in whole.items()}
    return {"duplicate": np.any([b["duplicate"] for b in blocks], axis=0), **out}


def _blocks(p: pd.DataFrame, customers: list, kernel: Callable) -> Iterator[tuple[pd.DataFrame, Block]]:
    """All potentials of a batch against some prepared customer blocks, in steps of bounded size."""
    for part in pieces(p, customers):
        yield part, _joined([kernel(part, c) for c in customers])


def _lists(values: np.ndarray, name: str) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = values.shape
    flat = pa.array(values.ravel().tolist(), pa.string()) if name == "b_company" else pa.array(values.ravel().astype(np.int64 if name == "b_id" else float))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)


def _record(part: pd.DataFrame, block: Block, names: list[str], kept: Sequence[str] = ()) -> pa.RecordBatch:
    values = {"id": pa.array(part["id"].to_numpy(dtype=np.int64)), **{c: pa.array(part[c].to_numpy()) for c in kept}, **{k: _lists(v, k) if v.ndim == 2 else pa.array(v) for k, v in block.items()}}
    return pa.RecordBatch.from_arrays([values[n] for n in names], names=names)


def _scored(p: pd.DataFrame, customers: list, kernel: Callable, names: list[str], kept: Sequence[str] = ()) -> pd.DataFrame:
    frames = [pd.DataFrame(columns=names)] if not len(p) else []
    for part, block in _blocks(p, customers, kernel):
        values = {k: list(v) if v.ndim == 2 else v for k, v in block.items()}
        frames.append(pd.DataFrame({"id": part["id"].to_numpy(), **{c: part[c].to_numpy() for c in kept}, **values})[names])
    return pd.concat(frames, ignore_index=True)


def _schema(components: list[str]) -> str:
    fields = ["id bigint", "duplicate boolean", "v_total array<double>"]
    fields += [f"v_{k} array<double>" for k in components]
    fields += ["b_total array<double>", "b_id array<bigint>", "b_company array<string>"]
    fields += [f"b_{k} array<double>" for k in components]
    return ", ".join(fields)


def _row_bytes(columns: list[str]) -> Column:
    """Rough size of a row's features in a worker: two numbers per gram and a fixed part."""
    grams = [F.size(n) for n in columns if n.startswith("g_")]
    return sum(grams[1:], grams[0]) * 16 + 512


def _feature_bytes(customers: DataFrame) -> int:
    return int(customers.agg(F.coalesce(F.sum(_row_bytes(customers.columns)), F.lit(0))).first()[0])


def _sent_texts(customers: DataFrame, rows: int, limit: int) -> list[pd.DataFrame] | None:
    """All customers in blocks, if they are small."""
    if _feature_bytes(customers) > limit:
        return None
    table = customers.toPandas()
    return [table.iloc[i : i + rows].reset_index(drop=True) for i in range(0, max(len(table), 1), rows)]


def _sent_companies(customers: DataFrame, limit: int) -> list[Broadcast] | None:
    """All customers in a few blocks, one if they are small once equal vectors are there once."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for at in range(0, len(batch), PACKED_ROWS):
                part = packed(batch.iloc[at : at + PACKED_ROWS])
                held = merged([held, part]) if held else part
                data = pickle.dumps(held.plain())
                if len(data) > PACKED_BYTES:
                    yield pd.DataFrame({"part": [data]})
                    held = None
        if held:
            yield pd.DataFrame({"part": [pickle.dumps(held.plain())]})

    stored = cut(customers.mapInPandas(pack, "part binary"))
    if stored.agg(F.coalesce(F.sum(F.length("part")), F.lit(0))).first()[0] > limit * SENT_BLOCKS:
        return None
    sent, parts, size = [], [], 0
    send = lambda some: sent.append(customers.sparkSession.sparkContext.broadcast(some.plain()))
    for row in stored.toLocalIterator():
        if parts and size + len(row["part"]) > limit:
            send(merged(parts))
            parts, size = [], 0
        parts.append(Packed(*pickle.loads(row["part"])))
        size += len(row["part"])
    if parts or not sent:
        send(merged(parts) if parts else packed(customers.limit(0).toPandas()))
    return sent


def _opened(sent: Broadcast) -> Companies:
    """A block that was sent; the worker does not keep the form it came in."""
    block = Companies(Packed(*sent.value))
    if getattr(sent, "_path", None):
        vars(sent).pop("_value", None)
    return block


def dealt(df: DataFrame, rows: int, size: int, least: int, name: str) -> tuple[DataFrame, int]:
    """Adds the number of a row's block: at most about `rows` rows and `size` bytes, and at least `least` blocks if there are rows.

    Blocks follow the running sum of the weights. Only the sum of each
    partition of the stored rows visits the driver.
    """
    weight = F.greatest(_row_bytes(df.columns) / F.lit(float(size)), F.lit(1.0 / rows))
    stored = cut(df.withColumns({"_weight": weight, "_part": F.spark_partition_id()}))
    sums = sorted((r["_part"], r["w"]) for r in stored.groupBy("_part").agg(F.sum("_weight").alias("w")).collect())
    total = sum(w for _, w in sums)
    blocks = max(1, least, math.ceil(total))
    before, at = {}, 0.0
    for part, w in sums:
        before[part], at = at, at + w
    kinds, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), [*df.columns, name]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if done is None:
                done = before[batch.column("_part")[0].as_py()]
            through = done + np.cumsum(batch.column("_weight").to_numpy())
            middle = (np.concatenate([[done], through[:-1]]) + through) / 2
            block = np.minimum((middle / total * blocks).astype(np.int32), blocks - 1)
            done = through[-1]
            columns = [c for c, f in zip(batch.columns, batch.schema) if f.name not in ("_weight", "_part")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(block)], names=names)

    return stored.mapInArrow(number, f"{kinds}, {name} int"), blocks


def _crossed(potentials: DataFrame, customers: DataFrame, rows: int, blocks: tuple[int, int], block_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with (pb, cb), so that every potential block meets every customer block once; and the number of customer blocks."""
    right, c_blocks = dealt(customers, blocks[1], block_bytes, 1, "cb")
    # enough blocks to give every core something to do, but none without rows
    wanted = min(math.ceil(2 * parallelism(potentials.sparkSession) / c_blocks), max(rows, 1))
    left, p_blocks = dealt(potentials, blocks[0], block_bytes, wanted, "pb")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return left.withColumn("cb", every(c_blocks)), right.withColumn("pb", every(p_blocks)), c_blocks


def compared(
    potentials: DataFrame,
    customers: DataFrame,
    columns: list[str],
    components: list[str],
    prepare: Callable[[pd.DataFrame], Texts | Companies],
    kernel: Callable[[pd.DataFrame, Texts | Companies], Block],
    sizes: tuple[int, int],
    blocks: tuple[int, int] = (POTENTIAL_BLOCK, CUSTOMER_BLOCK),
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    carried: list[str] | None = None,
) -> DataFrame:
    """Run `kernel` on all potentials and customers and keep the best values per potential.

    `sizes` are the two row counts, `blocks` the most rows of a block on either side. Columns of the potentials that are
    `carried`, with their types, are in the result as they are.
    """
    schema = ", ".join([_schema(components), *(carried or [])])
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kept = [c.split(" ")[0] for c in carried or []]
    customers = cut(customers.select(*columns))
    potentials = potentials.select(*columns, *kept)
    if prepare is Companies:
        blocks_sent = _sent_companies(customers, broadcast_bytes)
        if blocks_sent is not None:
            return potentials.mapInArrow(_against(blocks_sent, kernel, names, kept), schema)
    else:
        parts = _sent_texts(customers, blocks[1], broadcast_bytes)
        if parts is not None:
            sent = potentials.sparkSession.sparkContext.broadcast(parts)

            def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known = [prepare(c) for c in sent.value]
                for batch in batches:
                    for part, block in _blocks(batch.to_pandas(), known, kernel):
                        yield _record(part, block, names, kept)

            return potentials.mapInArrow(local, schema)

    left, right, c_blocks = _crossed(potentials, customers, sizes[0], blocks, block_bytes)

    def shuffled(key: tuple, p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _scored(p, [prepare(packed(c) if prepare is Companies else c)], kernel, names, kept).assign(cb=key[1])

    grouped = left.groupBy("pb", "cb").cogroup(right.groupBy("pb", "cb"))
    scored = grouped.applyInPandas(shuffled, schema + ", cb int")
    if c_blocks == 1:
        return scored.drop("cb")
    return _merged(scored, ["v_total", *[f"v_{k}" for k in components]], [c for c in names if c.startswith("b_")], c_blocks, kept)


def _against(sent: list[Broadcast], kernel: Callable, names: list[str], kept: list[str]) -> Callable:
    """Scores batches of potentials with all customers; of several blocks one at a time is open, and the next for a whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _opened(sent[0]) if len(sent) == 1 else None
        for batch in batches:
            p = batch.to_pandas()
            if not len(p):
                continue
            yield _record(p, _joined([kernel(p, only or _opened(s)) for s in sent]), names, kept)

    return run


def _merged(scored: DataFrame, values: list[str], best: list[str], parts: int, kept: list[str]) -> DataFrame:
    """Best values over all customer blocks, at most MERGE_FAN_IN lists at a time."""
    packed = scored.withColumn("_best", F.arrays_zip(*best))
    while parts > 1:
        parts = math.ceil(parts / MERGE_FAN_IN)
        packed = (
            packed.withColumn("cb", F.pmod("cb", F.lit(parts)))
            .groupBy("id", "cb")
            .agg(
                F.bool_or("duplicate").alias("duplicate"),
                *[F.first(c).alias(c) for c in kept],
                *[_largest(F.flatten(F.collect_list(v)), fixed.TOP_VALUES).alias(v) for v in values],
                _largest(F.flatten(F.collect_list("_best")), fixed.TOP_MATCHES).alias("_best"),
            )
        )
    return packed.select("id", "duplicate", *values, *[F.col(f"_best.{n}").alias(n) for n in best], *kept)


def _largest(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def score_companies(potentials: DataFrame, customers: DataFrame, sizes: tuple[int, int], **options) -> DataFrame:
    return compared(potentials, customers, BLOCK_COLUMNS, COMPONENTS, Companies, _company_block, sizes, **options)


def score_texts(potentials: DataFrame, customers: DataFrame, sizes: tuple[int, int], **options) -> DataFrame:
    return compared(potentials, customers, ["id", "company", "g_text", "w_text"], [], Texts, _text_block, sizes, **options)


def mean_of_top(values: str, k: int) -> Column:
    top = F.slice(F.col(values), 1, k)
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return F.when(F.size(top) > 0, mean).otherwise(0.0)


def top_mix(values: str) -> Column:
    """Weighted mix of the best value and the means of the best three and ten."""
    m = fixed.TOP_MIX
    return m["max"] * mean_of_top(values, 1) + m["top3"] * mean_of_top(values, 3) + m["top10"] * mean_of_top(values, 10)
