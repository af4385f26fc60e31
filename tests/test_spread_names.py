from pyspark.sql import functions as F

from leadkin.operators.resolve import prepared, resolve
from leadkin.operators import resolve as module


def test_spellings_are_worked_out_by_all_tasks(spark, monkeypatch):
    """Some thousand short names: before, adaptive execution left one task to do them all."""
    name = F.concat(F.lit("Firm "), F.col("id").cast("string"), F.lit(" 有限公司"))
    registry = spark.range(4000).select(
        F.col("id").alias("reg_ord"), name.alias("Company_Name"), F.lit("01").alias("Company_Status"), F.lit("").alias("Company_Status_Desc"), F.col("id").cast("string").alias("Business_Accounting_NO")
    )
    largest = lambda df: max(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
    stored = []
    monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: stored.append(cut(df)) or stored[-1])
    known = prepared(registry)
    assert known.count() == 4000 and largest(known) < 2000
    found = resolve(registry.select(F.col("reg_ord").alias("id"), F.col("Company_Name").alias("n")), None, "id", ["n"], known=known)
    assert found.filter("id = reg_ord").count() == 4000
    wanted = next(df for df in stored if "tid" in df.columns and "keywords" in df.columns)
    assert wanted.count() == 4000 and largest(wanted) < 2000
