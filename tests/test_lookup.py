"""Lookups stay even: rows are counted by partition, not only compared."""

import pytest
from pyspark.sql import functions as F

from leadkin.operators.lookup import heavy_light_lookup, left_lookup

ROWS = 30_000


@pytest.fixture
def steady(spark):
    """Without adaptive execution and broadcasts, so that the partitions are those of the join itself."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("false", "-1", "16")):
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(df):
    # the value found is read, as Spark leaves out a join of which nothing is used
    return max(r[1] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*"), F.max("v")).collect())


@pytest.mark.parametrize("blank", [None, "", "mixed"])
def test_blank_keys_are_dealt_evenly(steady, blank):
    unusable = F.when(F.col("id") % 2 == 0, F.lit("")) if blank == "mixed" else F.lit(blank).cast("string")
    probe = steady.range(ROWS).select("id", F.when(F.col("id") % 3 == 0, (F.col("id") % 500).cast("string")).otherwise(unusable).alias("k"))
    table = steady.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("v")).unionByName(steady.range(1).select(F.lit("").alias("k"), F.lit(7).cast("long").alias("v")))
    found = left_lookup(probe, table.filter("k <> ''"), ["k"], F.col("id"))
    assert largest(found) < 2 * ROWS / 16
    assert found.count() == ROWS
    assert found.filter("id % 3 = 0 and (v is null or v <> 10 * (id % 500))").count() == 0
    assert found.filter("id % 3 <> 0 and v is not null").count() == 0


def test_hot_keys_are_dealt_evenly(steady):
    """Two thirds of the rows have one key; it is sent to the workers and its rows are scattered."""
    probe = steady.range(ROWS).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 5000).otherwise(-1).alias("k"))
    table = probe.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") + 1)
    found = heavy_light_lookup(probe, table, ["k"], "n", ROWS, F.col("id"))
    assert largest(found) < 2 * ROWS / 16
    assert found.count() == ROWS and found.filter("v <> k + 1 or v is null").count() == 0
