"""Column rules shared by the jobs."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadkin import fixed


def conform(df: DataFrame, optional: dict[str, Any], *, needed: Iterable[str] = (), what: str = "table") -> DataFrame:
    """The table with every optional column, absent ones at their value; without a needed one it is refused."""
    if lacking := set(needed) - set(df.columns):
        raise ValueError(f"{what}: no column {', '.join(sorted(lacking))}")
    return df.withColumns({c: F.lit(value) for c, value in optional.items() if c not in df.columns})


def fixed_layout(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are null."""
    return conform(df, dict.fromkeys(columns)).select(*[col(c) for c in columns])


def existing_layout(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that exist, in this order."""
    return df.select(*[col(c) for c in columns if c in df.columns])


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def number(name: str) -> Column:
    return col(name).cast("string").try_cast("double")


def json_safe(df: DataFrame) -> DataFrame:
    """Not-a-number and infinities become null, points in time become ISO text, inside arrays, maps and structs too."""
    return df.select(*[_safe(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _safe(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def as_json(df: DataFrame) -> DataFrame:
    return json_safe(df).select(F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def compact_leads(leads: DataFrame) -> DataFrame:
    return existing_layout(leads, fixed.COMPACT_LEAD_COLUMNS)
