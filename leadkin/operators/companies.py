"""The columns of a company that the score reads, derived once per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text
from leadkin.operators.columns import col, conform, number


def active_flags() -> list[Column]:
    return [F.coalesce(number(c), F.lit(0.0)) > 0 for c in fixed.INDUSTRY_FLAGS]


def flag_bits() -> Column:
    """The ten industry flags as one number, bit by bit."""
    bits = [F.when(flag, F.lit(1 << i)).otherwise(0) for i, flag in enumerate(active_flags())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def industry_text() -> Column:
    """The industry column and the names of all active flags."""
    names = [F.when(flag, F.lit(c)) for c, flag in zip(fixed.INDUSTRY_FLAGS, active_flags())]
    return F.concat_ws(" ", F.nullif(text.clean(col(fixed.INDUSTRY)), F.lit("")), *names)


def companies(df: DataFrame, label: str) -> DataFrame:
    """(id, company, keys, texts, numbers, place, signal, coverage) for each row."""
    has_numbers = [c for c in (fixed.EMPLOYEES, fixed.CAPITAL) if c in df.columns]
    texts = [fixed.CUST_NO, fixed.PROFILE, fixed.INDUSTRY, fixed.SIGNAL, fixed.CITY, fixed.DISTRICT, *fixed.WELFARE_TEXT]
    numbers = [fixed.EMPLOYEES, fixed.CAPITAL, *fixed.INDUSTRY_FLAGS]
    df = conform(df, dict.fromkeys(texts, "") | dict.fromkeys(numbers), needed=[fixed.NAME, fixed.ROW_ORD], what=label)
    out = df.select(
        F.col(fixed.ROW_ORD).cast("long").alias("id"),
        col(fixed.NAME).cast("string").alias("company"),
        text.company_key(col(fixed.NAME)).alias("name_key"),
        text.clean(col(fixed.CUST_NO)).alias("cust_no"),
        text.clean(col(fixed.PROFILE)).alias("profile"),
        text.joined_text(*[col(c) for c in fixed.WELFARE_TEXT]).alias("welfare"),
        industry_text().alias("industry"),
        flag_bits().alias("flags"),
        number(fixed.EMPLOYEES).alias("employees"),
        number(fixed.CAPITAL).alias("capital"),
        text.clean(col(fixed.CITY)).alias("city"),
        text.clean(col(fixed.DISTRICT)).alias("district"),
        text.truthy(col(fixed.SIGNAL)).alias("signal"),
        reduce(lambda a, b: a | b, [col(c).isNotNull() for c in has_numbers], F.lit(False)).alias("_sized"),
    )
    checks = [
        F.length("profile") > 0,
        F.length("welfare") > 0,
        F.length("industry") > 0,
        F.col("_sized"),
        F.length(F.concat("city", "district")) > 0,
    ]
    coverage = reduce(lambda a, b: a + b, [c.cast("int") for c in checks]) / F.lit(float(len(checks)))
    return out.withColumn("coverage", coverage).drop("_sized")
