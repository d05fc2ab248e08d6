"""Sequences: one value at a time on the driver, or a whole DataFrame at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SequenceExhausted
from .recursion import stable


@dataclass
class Sequence:
    start: int = 1
    increment: int = 1
    minimum: int = 1
    maximum: int = 2**63 - 1
    cycle: bool = False
    next_value: int | None = None

    def __post_init__(self) -> None:
        if self.increment <= 0:
            raise ValueError("descending sequences are not supported")
        if self.next_value is None:
            self.next_value = max(self.start, self.minimum)

    def allocate(self) -> int:
        value = self.next_value
        if value > self.maximum:
            if not self.cycle:
                raise SequenceExhausted("Sequence exhausted")
            value = self.minimum
        self.next_value = value + self.increment
        return value


def assign(df: DataFrame, order: list[str], name: str, start: int = 1, increment: int = 1, buckets: int = 256) -> DataFrame:
    """Numbers rows in order without one task for all: ranges of the first column are numbered apart, then shifted."""
    ranged = stable(df.repartitionByRange(buckets, *order).withColumn("__p", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    sizes = ranged.groupBy("__p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__p", before.alias("__before")))  # at most ``buckets`` rows
    number = (F.col("__before") + F.col("__n") - 1) * increment + start
    return ranged.withColumn("__n", local).join(starts, "__p").withColumn(name, number.cast("long")).drop("__p", "__n", "__before")
