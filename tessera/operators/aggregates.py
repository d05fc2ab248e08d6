"""Aggregation with first-row columns and with user-defined aggregates that have a merge step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_row(df: DataFrame, keys: list[str], order: str, columns: list[str], *aggregates: Column) -> DataFrame:
    """Group columns taken from each group's first row by ``order``, with aggregates beside; map-side combined."""
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in columns if c != order])).alias("__first")
    out = df.groupBy(*keys).agg(first, *aggregates)
    return out.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in columns], *[c for c in out.columns if c not in (*keys, "__first")])


@dataclass(frozen=True)
class Aggregate:
    """A user-defined aggregate: what each row brings to named states, how states merge, and the value made of them.

    A state is merged by its entry in ``merge`` (F.sum, F.max, F.bit_or, ...; F.sum if it has none).  As states merge,
    Spark combines them before the shuffle, and no Python runs.
    """

    name: str
    accumulate: dict[str, Column]
    project: Column
    merge: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def over(self, df: DataFrame, *keys: str) -> DataFrame:
        states = df.groupBy(*keys).agg(*[self.merge.get(n, F.sum)(c).alias(n) for n, c in self.accumulate.items()])
        return states.select(*keys, self.project.alias(self.name))
