"""Connected components of links as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin.session import cut

STEPS = 64


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of the links (a, b).

    Alternating stars: every node hands its larger neighbours, then its smaller
    ones, to its smallest neighbour. The links of a node are never collected;
    its minimum is aggregated and joined back, so a node with very many links
    is split like any skewed join. Links are stored after each round.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        links = cut(_small(_large(links)))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    # every link is of a larger node, so the filter keeps all; it keeps the optimiser from leaving out the first step, too
    roots = least_by(links, "b", "a").filter("least > b").select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def least_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least, n): smallest value and number of rows of every key, also where one key has most of the rows.

    A key's rows are dealt to STEPS places by their value first, so no task gets them all, however
    small the partitions are in which they lie; the second step sees at most STEPS rows of a key.
    """
    place = F.pmod(F.xxhash64(value), F.lit(STEPS))
    parts = rows.groupBy(key, place.alias("_place")).agg(F.min(value).alias("least"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    out = links.join(least, links.b == least.k).select(F.col("a"), F.col("m").alias("b"))
    return out.distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    joined = links.join(least, links.a == least.k)
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
