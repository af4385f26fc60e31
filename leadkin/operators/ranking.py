"""Numbering and ranking of all rows without pulling them into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin.operators.lookup import heavy_light_lookup
from leadkin.session import cut, parallelism


def number_rows(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Add 1..N in the given total order; also returns N.

    Rows are range-partitioned and sorted, each takes its place in its
    partition, and the sizes of the earlier partitions are added. Only those
    sizes, one number per partition, visit the driver.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before = [0, *accumulate(r["count"] for r in sizes)]
    if not sizes:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at"), 0
    starts = spark.createDataFrame([(int(r["part"]), b) for r, b in zip(sizes, before)], "_part long, _before long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return numbered.withColumn(name, place).drop("_at", "_part", "_before"), before[-1]


def with_percentile(ranked: DataFrame, score: str, rank: str, total: int, name: str) -> DataFrame:
    """Share of the average rank among equal scores, lowest score first, in percent.

    Equal scores are neighbours in the ranking, so their average rank follows
    from the first one and their number.
    """
    ties = (
        ranked.groupBy(score)
        .agg(F.count("*").alias("_equal"), F.min(rank).alias("_first"))
        .filter(F.col("_equal") > 1)
    )
    joined = heavy_light_lookup(ranked, ties, [score], "_equal", total, F.col(rank))
    from_top = F.coalesce(F.col("_first") + (F.col("_equal") - 1) / 2.0, F.col(rank).cast("double"))
    return joined.withColumn(name, (total + 1 - from_top) / F.lit(float(max(total, 1))) * 100).drop("_equal", "_first")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows, in their stored order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)
