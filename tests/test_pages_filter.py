"""Pages that nobody asks for stay where they are."""

from pyspark.sql import functions as F

from leadkin.operators.lookup import may_match
from leadkin.plans.enrich import pages_at


def test_bitmap_lets_all_wanted_and_few_others_through(spark):
    rows = spark.range(200_000).select(F.col("id").alias("a"), F.concat(F.lit("k"), F.col("id")).alias("b"), F.lit("x").alias("_bits_of"))
    rows = rows.unionByName(spark.createDataFrame([(None, "k1", "n"), (1, None, "n")], "a long, b string, _bits_of string"))
    wanted = rows.filter("a % 100 = 7").select("a", "b")
    got = may_match(rows, wanted, ["a", "b"])
    assert got.columns == rows.columns
    assert got.join(wanted, ["a", "b"], "left_semi").count() == 2_000 == wanted.count()
    assert got.count() < 2_000 + 50
    # a bitmap far too small lets through more, never less
    small = may_match(rows, wanted, ["a", "b"], bits=1 << 10)
    assert small.join(wanted, ["a", "b"], "left_semi").count() == 2_000
    assert may_match(rows, wanted.limit(0), ["a", "b"]).count() == 0 == may_match(rows.limit(0), wanted, ["a", "b"]).count()


def test_texts_are_filtered_before_they_are_moved(spark, tmp_path):
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://site"), F.col("id") % 15_000, F.lit(".com/")).alias("url"), F.repeat(F.lit("html "), 20).alias("html"))
    pages.unionByName(spark.createDataFrame([(-1, None, "x"), (None, "https://site5.com", "no number")], "page_id long, url string, html string")).write.parquet(f"{tmp_path}/pages")
    stored = spark.read.parquet(f"{tmp_path}/pages")
    urls = spark.createDataFrame([(f"http://www.site{i}.com",) for i in (1, 5, 14_999, 77_777)], "url string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if too many pages were wanted
    try:
        found = pages_at(urls, stored)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.url, len(r.html)) for r in rows) == [("https://site1.com/", 100), ("https://site14999.com/", 100), ("https://site5.com/", 100)]
    # from the join downwards: the texts meet the bitmap below their exchange
    moved = next(part for part in plan.split("Exchange hashpartitioning")[1:] if "html" in part)
    assert "BroadcastHashJoin" in moved and "getbit" in moved
