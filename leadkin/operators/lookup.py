"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 2000
BROADCAST_ROWS = 1_000_000
SCATTER = 1_000_000
FILTER_BITS = 1 << 26
_BUCKET = 1 << 15  # bits in one row of a bitmap


def _scattered(to_look_up: Column, spread: Column) -> Column:
    """Zero for rows that may find something, a place of their own for all others."""
    return F.when(to_look_up, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(spread), F.lit(SCATTER)) + 1)


def _zero(on: list[str]) -> Column:
    """Always 0, worked out from the key: of a literal the optimiser would make a filter, and rows would be dealt by the key alone."""
    return F.pmod(F.xxhash64(*on), F.lit(1).cast("long"))


def left_lookup(probe: DataFrame, table: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """Left join to a table that is unique on `on`; null and blank keys never meet anything.

    Rows without a usable key are scattered over all partitions instead of
    piling up on one. Other hot keys are left to the skew join of adaptive
    execution, which may split the probe side because the table is unique.
    """
    usable = F.lit(True)
    for key in on:
        usable = usable & F.coalesce(F.col(key).cast("string"), F.lit("")).__ne__("")
    return (
        probe.withColumn("_scatter", _scattered(usable, spread))
        .join(table.withColumn("_scatter", _zero(on)), [*on, "_scatter"], "left")
        .drop("_scatter")
    )


def heavy_light_lookup(
    probe: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, spread: Column
) -> DataFrame:
    """Left join to a unique table whose `weight` says how many probe rows have each key.

    `total` is the sum of the weights, so at most HEAVY_SHARE keys can weigh
    more than total / HEAVY_SHARE: that proven bound is what gets broadcast.
    The other keys are light and go through an ordinary shuffle join, in which
    the rows already served are scattered.
    """
    limit = max(total // HEAVY_SHARE, 1)
    values = [c for c in table.columns if c not in on]
    heavy = table.filter(F.col(weight) > limit).select(*on, F.struct(*values).alias("_heavy"))
    light = table.filter(F.col(weight) <= limit).select(
        *on, F.struct(*values).alias("_light"), _zero(on).alias("_scatter")
    )
    joined = (
        probe.join(F.broadcast(heavy), on, "left")
        .withColumn("_scatter", _scattered(F.col("_heavy").isNull(), spread))
        .join(light, [*on, "_scatter"], "left")
    )
    found = F.coalesce("_heavy", "_light")
    return joined.select(*probe.columns, *[found[v].alias(v) for v in values])


def may_match(rows: DataFrame, wanted: DataFrame, on: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key is in `wanted`, and few others; null keys are left out.

    Hashes of the wanted keys set bits in a bitmap that is sent to the workers,
    so rows with long values are dropped before a join moves them. It is never
    larger than `bits` (8 MB), however many keys are wanted; with more keys it
    lets more rows through, up to all of them.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    bucket, bit = F.floor(place / _BUCKET).cast("long"), F.pmod(place, F.lit(_BUCKET))
    maps = wanted.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    known = F.lit(True)
    for key in on:
        known = known & F.col(key).isNotNull()
    probe = rows.filter(known).withColumns({"_bucket": bucket, "_bit": bit})
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(F.col("_bit"), F.lit(8)).cast("int")) == 1
    return probe.join(F.broadcast(maps), "_bucket").filter(hit).select(*rows.columns)
