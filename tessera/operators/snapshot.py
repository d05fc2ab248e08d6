"""Snapshot visibility of rows that carry the transactions which created and deleted them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snapshot:
    """Transactions below xmin are settled, those from xmax on are not begun, those in_progress are not yet done."""

    xmin: int
    xmax: int
    in_progress: tuple[int, ...] = ()
    reader: int = 0

    def done(self, txn: Column) -> Column:
        running = txn.isin(*self.in_progress) if self.in_progress else F.lit(False)
        own = (txn == self.reader) if self.reader else F.lit(False)
        return (txn != 0) & (own | (txn < self.xmin) | ((txn < self.xmax) & ~running))


def visible(df: DataFrame, snapshot: Snapshot, created: str = "created_txn", deleted: str = "deleted_txn") -> DataFrame:
    """Rows created by what the snapshot (or the reader) sees, and not so deleted; transaction 0 is none."""
    return df.filter(snapshot.done(F.col(created)) & ~snapshot.done(F.col(deleted)))
