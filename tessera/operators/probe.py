"""Point probes, and a probe that falls back to the rest of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(key: dict) -> Column:
    return reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in key.items()])


def probe(df: DataFrame, key: dict) -> DataFrame:
    """Rows with the key; the comparison reaches the parquet scan as a pushed filter."""
    return df.filter(matches(key))


def probe_then_rest(df: DataFrame, key: dict, tag: str = "from_probe") -> DataFrame:
    """All rows once, hits tagged 1 and the rest 0; order by the tag, descending, for hits first.  One scan, no join."""
    return df.withColumn(tag, F.coalesce(matches(key), F.lit(False)).cast("int"))
