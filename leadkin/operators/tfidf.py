"""Weighted character grams of two sets of texts.

Grams are whole numbers and are counted inside each task, many texts at a time. How many
documents have a gram is summed up inside each task first, so what is shuffled grows with
the grams a task sees and not with its texts. A vocabulary of up to SENT_ROWS grams is sent
to the workers, where a row's weights come straight from its text: nothing else is shuffled,
and no gram ever is a row. Beyond that size grams are rows and look their weights up in a join.
Grams are made once for the counts and once for the weights: kept in between, they would take
about nine times the room of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import grams
from leadkin.operators.lookup import BROADCAST_ROWS, heavy_light_lookup
from leadkin.session import cut

CUSTOMER, POTENTIAL = "c", "p"
SENT_ROWS = 400_000
GRAM = ["kind", "code", "last"]
_HELD = 500_000  # grams of one kind a task sums up before it hands them on
_LETTERS = 1 << 18


def gram_rows(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, kind, code, last, tf). Grams are counted inside each row, so nothing shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            for i in range(len(fields)):
                for g in grams.grams(batch.column(i + 1).to_pylist(), i):
                    numbers = np.full(len(g.row), g.kind, dtype=np.int32), g.code[g.gram], g.last[g.gram], g.tf
                    columns = [batch.column(0).take(pa.array(g.row)), *map(pa.array, numbers)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", *GRAM, "tf"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", *_prepared(fields)).mapInArrow(run, f"id {kind}, kind int, code long, last long, tf long")


def _prepared(fields: list[str]) -> list[Column]:
    return [F.lower(F.regexp_replace(F.col(f), r"(?U)\s\s+", " ")).alias(f"f{i}") for i, f in enumerate(fields)]


def _of_field(number: int) -> Column:
    return F.floor(F.col("kind") / len(grams.SIZES)) == number


def _pieces(batches: Iterator[pa.RecordBatch], first: int = 0) -> Iterator[pa.RecordBatch]:
    """Texts of few letters at a time, as their grams take many times their size; at least one row."""
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns[first:]:
            size += pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_numpy(zero_copy_only=False)
        through = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            limit = (through[at - 1] if at else 0) + _LETTERS
            end = max(int(np.searchsorted(through, limit, side="right")), at + 1)
            yield batch.slice(at, end - at)
            at = end


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def document_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(kind, code, last, df): in how many texts of a task a gram is; a gram may come several times."""

    def rows(kind: int, code: np.ndarray, last: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        columns = np.full(len(code), kind, dtype=np.int32), code, last, df
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=[*GRAM, "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in _pieces(batches):
            for i in range(len(fields)):
                for g in grams.grams(batch.column(i).to_pylist(), i):
                    df = np.bincount(g.gram, minlength=len(g.code))
                    if g.last.any():
                        yield rows(g.kind, g.code, g.last, df)
                        continue
                    parts = held.setdefault(g.kind, [])
                    parts.append((g.code, df))
                    if sum(len(c) for c, _ in parts) > _HELD:
                        held[g.kind] = [_summed(parts)]
                        if len(held[g.kind][0][0]) > _HELD // 2:
                            code, df = held.pop(g.kind)[0]
                            yield rows(g.kind, code, np.zeros(len(code), dtype=np.int64), df)
        for kind, parts in held.items():
            code, df = _summed(parts)
            yield rows(kind, code, np.zeros(len(code), dtype=np.int64), df)

    return docs.select(*_prepared(fields)).mapInArrow(run, "kind int, code long, last long, df long")


def vocabulary(counts: DataFrame, documents: int) -> DataFrame:
    """One row per gram of a field that is in at most 95 % of all documents, with a stable number.

    A gram found in every document costs a few rows per task. The result is
    stored: its numbers must not change later.
    """
    counted = counts.groupBy(*GRAM).agg(
        F.sum("df").alias("df"), F.sum(F.when(F.col("side") == CUSTOMER, F.col("df")).otherwise(0)).alias("df_customers")
    )
    kept = counted.filter(F.col("df") <= fixed.MAX_DOCUMENT_SHARE * documents)
    idf = F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0
    return cut(kept.withColumn("idf", idf).withColumn("gid", F.monotonically_increasing_id()))


def vocabulary_of(potentials: DataFrame, customers: DataFrame, fields: list[str], documents: int) -> DataFrame:
    sides = ((POTENTIAL, potentials), (CUSTOMER, customers))
    rows = [document_counts(docs, fields).withColumn("side", F.lit(side)) for side, docs in sides]
    return vocabulary(rows[0].unionByName(rows[1]), documents)


def with_vectors(docs: DataFrame, fields: list[str], words: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """`docs` with (g_<field>, w_<field>) in the place of its text fields; both are empty where no gram counts."""
    if words.count() <= sent_rows:
        return _weighted_in_place(docs, fields, words)
    kinds = [(f"{kind}_{f}", item) for f in fields for kind, item in (("g", "bigint"), ("w", "double"))]
    joined = docs.drop(*fields).join(unit_vectors(docs.select("id", *fields), fields, words), "id", "left")
    return joined.withColumns({name: F.coalesce(name, F.expr(f"cast(array() as array<{item}>)")) for name, item in kinds})


class _Known:
    """The sent vocabulary, opened for looking up many grams at once."""

    def __init__(self, kind: np.ndarray, code: np.ndarray, last: np.ndarray):
        self.plain = {}
        for k in np.unique(kind):
            at = np.flatnonzero((kind == k) & (last == 0))
            at = at[np.argsort(code[at])]
            self.plain[int(k)] = code[at], at
        odd = np.flatnonzero(last)
        self.odd = {(int(kind[i]), int(code[i]), int(last[i])): i for i in odd}

    def places(self, g: grams.Grams) -> np.ndarray:
        """Place of every distinct gram in the vocabulary, -1 where it has none."""
        if g.last.any():
            return np.array([self.odd.get((g.kind, c, e), -1) for c, e in zip(g.code.tolist(), g.last.tolist())], dtype=np.int64)
        code, at = self.plain.get(g.kind, (np.empty(0, dtype=np.int64),) * 2)
        if not len(code):
            return np.full(len(g.code), -1)
        found = np.minimum(np.searchsorted(code, g.code), len(code) - 1)
        return np.where(code[found] == g.code, at[found], -1)


def _weighted_in_place(docs: DataFrame, fields: list[str], words: DataFrame) -> DataFrame:
    """Vectors worked out in each row's task from the vocabulary, of which every worker has a copy."""
    table = words.select(*GRAM, "gid", "idf", (F.col("df_customers") > 0).alias("shared")).toPandas()
    sent = docs.sparkSession.sparkContext.broadcast({c: table[c].to_numpy() for c in table.columns})
    opened: list[_Known] = []

    def vectors(number: int):
        def weigh(texts: pa.Array) -> pa.Array:
            v = sent.value
            if not opened:
                opened.append(_Known(*[v[c] for c in GRAM]))
            lists = [], []
            for piece in _pieces([pa.RecordBatch.from_arrays([texts], names=["t"])]):
                row, at, tf = [], [], []
                for g in grams.grams(piece.column(0).to_pylist(), number):
                    place = opened[0].places(g)[g.gram]
                    has = place >= 0
                    for into, values in ((row, g.row), (at, place), (tf, g.tf)):
                        into.append(values[has])
                row, at, tf = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (row, at, tf))
                w = (1.0 + np.log(tf)) * v["idf"][at]
                length = np.sqrt(np.bincount(row, weights=w * w, minlength=piece.num_rows))
                keep = v["shared"][at]
                row, at, w = row[keep], at[keep], w[keep]
                order = np.argsort(row, kind="stable")
                ends = np.cumsum(np.bincount(row, minlength=piece.num_rows))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                for into, values in zip(lists, (v["gid"][at], w / length[row])):
                    into.append(pa.ListArray.from_arrays(offsets, pa.array(values[order])))
            kinds = pa.list_(pa.int64()), pa.list_(pa.float64())
            found = [pa.concat_arrays(x) if x else pa.array([], kind) for x, kind in zip(lists, kinds)]
            return pa.StructArray.from_arrays(found, names=["g", "w"])

        return F.arrow_udf(weigh, "struct<g: array<bigint>, w: array<double>>").asNondeterministic()

    found = docs.withColumns({f"_v{i}": vectors(i)(f) for i, f in enumerate(_prepared(fields))})
    parts = {f"{kind}_{f}": F.col(f"_v{i}.{kind}") for i, f in enumerate(fields) for kind in "gw"}
    return found.withColumns(parts).drop(*fields, *[f"_v{i}" for i in range(len(fields))])


def unit_vectors(docs: DataFrame, fields: list[str], words: DataFrame) -> DataFrame:
    """(id, g_<field>, w_<field>): the grams any customer has, weights of unit length.

    A gram that no customer has counts towards the length of a potential's
    vector but can never meet a partner, so it is not carried along.
    """
    counted = gram_rows(docs, fields)
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("rows")).first()
    if size["n"] <= BROADCAST_ROWS:
        weighted = counted.join(F.broadcast(words), GRAM)
    else:
        weighted = heavy_light_lookup(
            counted, words, GRAM, "df", size["rows"], F.struct("id", "code")
        ).filter(F.col("gid").isNotNull())
    w = (1.0 + F.log("tf")) * F.col("idf")
    parts, out = [], ["id"]
    for i, field in enumerate(fields):
        here = _of_field(i)
        shared = here & (F.col("df_customers") > 0)
        parts += [
            F.sqrt(F.sum(F.when(here, w * w))).alias(f"_n{i}"),
            F.collect_list(F.when(shared, F.struct(F.col("gid"), w.alias("w")))).alias(f"_v{i}"),
        ]
        out += [
            F.col(f"_v{i}.gid").alias(f"g_{field}"),
            _scaled(f"_v{i}.w", f"_n{i}").alias(f"w_{field}"),
        ]
    return weighted.groupBy("id").agg(*parts).select(*out)


def _scaled(values: str, length: str) -> Column:
    return F.transform(values, lambda w: w / F.col(length))
