"""Business codes and the industries they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin import fixed

CODE = r"[A-Z]{1,2}\d{5,6}"


def codes_in(item: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(item, F.lit(""))), F.lit(CODE), F.lit(0))


def one_hot(rows: DataFrame, key: str, letter: Column) -> DataFrame:
    """One 0/1 column per industry and the industry names in letter order."""
    flags = [F.max(F.when(letter == k, 1).otherwise(0)).alias(v) for k, v in fixed.INDUSTRY_BY_LETTER.items()]
    wide = rows.groupBy(key).agg(*flags)
    names = F.concat_ws(",", *[F.when(F.col(f"`{v}`") == 1, F.lit(v)) for v in fixed.INDUSTRY_FLAGS])
    return wide.withColumn(fixed.INDUSTRY, names)


def company_industries(items: DataFrame, key: str) -> DataFrame:
    """Companies with at least one code, with flags and industry text; codes beyond A–J count as none."""
    codes = items.select(key, F.explode(codes_in(F.col("item"))).alias("code"))
    return one_hot(codes, key, F.substring("code", 1, 1))
