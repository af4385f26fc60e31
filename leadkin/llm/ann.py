"""Approximate nearest neighbours (operator 1): a tree of k-means cells, searched best bin first.

Tree. A bounded sample of at most SAMPLE vectors and SAMPLE_NUMBERS numbers is split by k-means into
BRANCH cells, each cell again, until a cell stands for about LEAF vectors of
the whole table; there are at most MAX_LEAVES leaves. The tree is sent to the
workers (MAX_LEAVES x dimensions numbers at most); every vector is indexed by
going down to its leaf.

Search. A query keeps a queue of cells by distance, opens the nearest, and so
visits leaves from near to far. How many leaves all queries visit is
calibrated: CALIBRATE queries are answered exactly, and the number of visits is
widened until they find TARGET of their true neighbours.

Equal vectors are one entry with their smallest ids (one more than can be
asked for), so a vector that a third of all rows share is a few numbers. Each
leaf is cut into blocks of at most BLOCK entries by a hash, and so are its
queries; a task compares one block of each and keeps the best per query. Lists
of a query are merged afterwards. Distances are Euclidean, of the original
numbers in double precision.

Cases. Vectors that are null, zero, hold null or non-finite numbers, or have
another length than most do not take part; nor do rows without an id. A row
that occurs twice counts once; an id with several vectors has several rows,
none of which is a candidate for its own id, so such queries are compared on
their own, without the vectors that only their id has. With fewer candidates than k all
are returned. Ties go to the smaller id. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadkin.llm.common import hash_share
from leadkin.session import cut

K = 10
LEAF = 256
BRANCH = 16
MAX_LEAVES = 16384
SAMPLE = 65536
SAMPLE_NUMBERS = 1 << 24
CALIBRATE = 64
TARGET = 0.97
BLOCK = 4096


class Tree(NamedTuple):
    centres: np.ndarray  # of all cells; cell 0 is the root
    children: list[tuple[int, int]]  # first and last + 1 cell below; (0, 0) for a leaf
    leaf: np.ndarray  # number of a leaf, -1 for inner cells

    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest cell on every level."""
        cell = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[cell] < 0)
            if not len(inner):
                return self.leaf[cell]
            for c in np.unique(cell[inner]):
                rows = inner[cell[inner] == c]
                a, b = self.children[c]
                cell[rows] = a + np.argmin(_squared(x[rows], self.centres[a:b]), axis=1)

    def nearest_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue, seen = [(0.0, 0)], 0
        while queue:
            _, cell = heapq.heappop(queue)
            if self.leaf[cell] >= 0:
                seen += 1
                yield int(self.leaf[cell])
            else:
                a, b = self.children[cell]
                for i, d in enumerate(((self.centres[a:b] - q) ** 2).sum(axis=1)):
                    heapq.heappush(queue, (float(d), a + i))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest centre of each row); empty cells are dropped."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        near = np.argmin(_squared(x, centres), axis=1)
        used, near = np.unique(near, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, near, x)
        centres = sums / np.bincount(near)[:, None]
    return centres, np.argmin(_squared(x, centres), axis=1)


def grow(sample: np.ndarray, rows: int, leaf: int = LEAF, branch: int = BRANCH) -> Tree:
    """Split the sample until a cell stands for about `leaf` of `rows` vectors."""
    leaves = min(MAX_LEAVES, max(1, rows // leaf))
    per_leaf = max(1, len(sample) // leaves)
    centres, children, waiting = [sample.mean(axis=0)], [(0, 0)], [(0, sample)]
    while waiting:
        cell, x = waiting.pop(0)
        if len(x) <= max(per_leaf, 1) * 1.5 or (x == x[0]).all():
            continue
        middle, near = kmeans(x, min(branch, max(2, len(x) // per_leaf)))
        if len(middle) < 2:
            continue
        children[cell] = (len(centres), len(centres) + len(middle))
        for i, c in enumerate(middle):
            waiting.append((len(centres), x[near == i]))
            centres.append(c)
            children.append((0, 0))
        waiting = [w for w in waiting if len(w[1])]
    ends = np.array([c == (0, 0) for c in children])
    return Tree(np.array(centres), children, np.where(ends, np.cumsum(ends) - 1, -1))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """id, v (double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else 0))


def _matrix(column: pa.Array | list) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _best(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query the k nearest of x by exact distance (and all that tie with the last)."""
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        rough = _squared(part, x)
        slack = 1e-9 * ((part * part).sum(axis=1) + (x * x).sum(axis=1).max())
        for i, d in enumerate(rough):
            limit = np.partition(d, k - 1)[k - 1] + slack[i] if len(d) > k else np.inf
            near = np.flatnonzero(d <= limit)
            exact = np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1))
            keep = np.argsort(exact, kind="stable")
            keep = keep[exact[keep] <= exact[keep[min(k, len(keep)) - 1]]]
            yield at + i, near[keep], exact[keep]


def search(vectors: DataFrame, is_query: Column, vector: str = "embedding", k: int = K) -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score), and the calibration: leaves, visits and the recall expected."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, vector)
    # a window with a limit on its rank is cut down before the shuffle
    order = Window.partitionBy("v").orderBy("id")
    smallest = rows.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    entries = cut(smallest.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.xxhash64("v", F.element_at("ids", 1))))
    n = entries.count()
    if not n:
        return empty, {}
    size = max(1, min(SAMPLE, SAMPLE_NUMBERS // entries.select(F.size("v")).first()[0]))
    chosen = entries.filter(hash_share("entry", 5, min(1.0, 2 * size / n))).orderBy("entry").limit(size).select("v").toPandas()["v"]
    sample = np.array(chosen.tolist(), dtype=float) if len(chosen) else np.array(entries.select("v").limit(1).toPandas()["v"].tolist())
    tree = grow(sample, n)
    sent = spark.sparkContext.broadcast(tuple(tree))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*sent.value)
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["v", "ids", "entry", "leaf"])

    index = cut(entries.select("v", "ids", "entry").mapInArrow(placed, "v array<double>, ids array<long>, entry long, leaf long"))
    # ids with one vector share a query by vector; an id with several has queries of its own, that leave it out
    several = rows.filter(is_query).select("id", "v").distinct().groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.col("id").alias("own"))
    asked = rows.filter(is_query).select("id", "v").distinct().join(several, "id", "left")
    asked = cut(asked.withColumn("q", F.when(F.col("own").isNull(), F.xxhash64("v")).otherwise(F.xxhash64("v", "own"))))
    different = cut(asked.groupBy("v", "q", "own").agg(F.count("*").alias("n")).select("q", "v", "own"))
    visits, recall = _calibrated(index, different, tree, k)
    found = _searched(index, different, sent, visits, k)
    return _ranked(found, asked, k), {"entries": n, "leaves": tree.leaves(), "visits": visits, "recall": recall}


def _calibrated(index: DataFrame, queries: DataFrame, tree: Tree, k: int) -> tuple[int, float]:
    """Visits that find TARGET of the true neighbours of a few queries, which are compared with every entry."""
    some = queries.select("q", "v").orderBy(F.xxhash64(F.lit(3), "q")).limit(CALIBRATE).toPandas()
    if not len(some):
        return 1, 1.0
    asked = np.array(some["v"].tolist(), dtype=float)
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            leaf = batch.column(1).to_numpy()
            for i, near, exact in _best(sent.value, _matrix(batch.column(0)), k + 1):
                merged = kept.get(i, []) + list(zip(exact.tolist(), leaf[near].tolist()))
                kept[i] = sorted(merged)[: k + 1]
        rows = [(i, d, leaf) for i, found in kept.items() for d, leaf in found]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.float64()), pa.array(columns[2], type=pa.int64())], names=["i", "d", "leaf"]
        )

    true = index.select("v", "leaf").mapInArrow(nearest, "i long, d double, leaf long")
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "leaf"))
    true = true.withColumn("place", place).filter(F.col("place") <= k + 1).toPandas()
    steps = []
    for i, q in enumerate(asked):
        order = {leaf: s for s, leaf in enumerate(tree.nearest_first(q), 1)}
        steps += [order[leaf] for leaf in true.loc[true["i"] == i, "leaf"]]
    steps = np.array(steps)
    visits = 1
    while (steps <= visits).mean() < TARGET:
        visits += max(1, visits // 8)
    visits = min(visits, tree.leaves())
    return visits, float((steps <= visits).mean())


def _searched(index: DataFrame, queries: DataFrame, sent, visits: int, k: int) -> DataFrame:
    """q, d, ids: the best entries of every different query, block by block."""

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*sent.value)
        for batch in batches:
            which, leaves = [], []
            for i, q in enumerate(_matrix(batch.column(1))):
                order = tree.nearest_first(q)
                found = [leaf for leaf, _ in zip(order, range(visits))]
                which += [i] * len(found)
                leaves += found
            taken = batch.take(pa.array(which, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves, type=pa.int64())], names=["q", "v", "own", "leaf"])

    probes = queries.select("q", "v", "own").mapInArrow(to_leaves, "q long, v array<double>, own long, leaf long")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    sizes = (
        index.groupBy("leaf").agg(F.count("*").alias("rows"))
        .join(probes.groupBy("leaf").agg(F.count("*").alias("probes")), "leaf")
        .select("leaf", blocks("rows").alias("row_blocks"), blocks("probes").alias("probe_blocks"))
    )
    sizes = F.broadcast(cut(sizes))  # a row per leaf, of which there are at most MAX_LEAVES
    part = lambda key, n: F.pmod(F.xxhash64(F.lit(7), key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, "leaf").select("leaf", part("entry", "row_blocks").alias("rb"), every("probe_blocks").alias("pb"), "v", "ids")
    right = probes.join(sizes, "leaf").select("leaf", every("row_blocks").alias("rb"), part("q", "probe_blocks").alias("pb"), "q", "v", "own")

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "d": [], "ids": []}
        if len(x) and len(q):
            ids, vectors = x["ids"].tolist(), np.array(x["v"].tolist(), dtype=float)
            only = np.array([int(i[0]) if len(i) == 1 else None for i in ids], dtype=object)
            for own, part in q.groupby("own", dropna=False):
                rest = np.arange(len(ids)) if pd.isna(own) else np.flatnonzero(only != int(own))
                names = part["q"].to_numpy()
                if not len(rest):
                    continue
                for i, near, exact in _best(np.array(part["v"].tolist(), dtype=float), vectors[rest], k + 1):
                    out["q"] += [names[i]] * len(near)
                    out["d"] += exact.tolist()
                    out["ids"] += [ids[j] for j in rest[near]]
        return pd.DataFrame(out)

    keys = ["leaf", "rb", "pb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "q long, d double, ids array<long>")


def _ranked(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query row from the entries found for its vector; its own id is no candidate."""
    each = found.select("q", "d", F.explode("ids").alias("vec_id"))
    owned = asked.filter("own is not null").select("q", "own").distinct()
    each = each.join(owned, "q", "left").filter("own is null or vec_id <> own").drop("own")
    # one more than k per different vector: only the query's own id can drop out, once as it has one vector
    nearest = each.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).filter(F.col("place") <= k + 1)
    lists = nearest.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "vec_id"))).alias("near"))
    own = asked.select("id", "q").join(cut(lists), "q")
    kept = own.select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("near"))
    return kept.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.d").alias("score")
    )
