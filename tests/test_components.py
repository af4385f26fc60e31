"""Connected components against a plain search, and what one task gets of a large one."""

import random

import pytest
from pyspark.sql import functions as F

from leadkin.operators import components as c


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("links", [
    [], [(3, 3)], [(1, 2), (2, 1), (1, 2)],
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 300)] + [(500, 501)],
    [(r.randrange(200), r.randrange(200)) for r in [random.Random(4)] for _ in range(120)],
])
def test_components(spark, links):
    found = c.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == plain(links)


def test_no_task_gets_all_rows_of_a_key(spark):
    """One key has 3,000 of 3,300 rows, each in a partition that has few of them."""
    rows = spark.range(3300).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), (F.col("id") + 7).alias("v"))
    spread = rows.repartition(400)
    found = {r.k: (r.least, r.n) for r in c.least_by(spread, "k", "v").collect()}
    assert found == {1: (7, 3000), **{i: (i + 7, 1) for i in range(3000, 3300)}}
    place = F.pmod(F.xxhash64("v"), F.lit(c.STEPS))
    dealt = spread.repartition(200, "k", place).groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 600


def test_first_step_stays_in_the_plan(spark):
    links = spark.createDataFrame([(2, 1), (3, 1)], "a long, b long")
    roots = c.least_by(links, "b", "a").filter("least > b").select("b")
    assert roots._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
