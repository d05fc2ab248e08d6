"""Recursive queries as semi-naive loops, and worktables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of its own only where the session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        import tempfile

        where = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: the plan is short, a lost executor costs nothing, no cache is held."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def with_recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], max_levels: int = 10_000) -> DataFrame:
    """anchor UNION ALL step(anchor) UNION ALL step(step(anchor)) ... until a level is empty.

    Each level sees the rows of the one before, and is made once.
    """
    schema, out, delta = anchor.schema, anchor, anchor
    for _ in range(max_levels):
        delta = step(delta)
        if [f.dataType for f in delta.schema] != [f.dataType for f in schema]:
            raise ValueError("the recursive member must have the anchor's column types")
        delta = stable(delta.toDF(*schema.names))
        if delta.isEmpty():
            return out
        out = out.unionAll(delta)
    raise RecursionError(f"no end after {max_levels} levels")


class Worktables:
    """Materialised inputs shared by id and snapshot; a new snapshot materialises anew, appended deltas are seen once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}

    def spool(self, name: str, child: Callable[[], DataFrame], snapshot: object = None) -> DataFrame:
        held = self.tables.get(name)
        if held is None or held["snapshot"] != snapshot:
            if held:
                held["rows"].unpersist()
            rows = child().persist()
            held = self.tables[name] = {"snapshot": snapshot, "rows": rows, "deltas": [], "seen": 0, "seed": True}
        out = held["rows"]
        for d in held["deltas"]:
            out = out.unionAll(d)
        return out

    def append_delta(self, name: str, rows: DataFrame) -> None:
        self.tables[name]["deltas"].append(rows)

    def deltas(self, name: str) -> list[DataFrame]:
        """Those not yet processed."""
        held = self.tables[name]
        return held["deltas"][held["seen"] :]

    def mark_processed(self, name: str) -> None:
        self.tables[name]["seen"] = len(self.tables[name]["deltas"])

    def next_seed(self, name: str) -> DataFrame | None:
        """The rows that the table was made of, once."""
        held = self.tables[name]
        first, held["seed"] = held["seed"], False
        return held["rows"] if first else None

    def next_delta(self, name: str) -> DataFrame | None:
        """The oldest delta not yet processed, which this marks as processed."""
        held = self.tables[name]
        if held["seen"] == len(held["deltas"]):
            return None
        held["seen"] += 1
        return held["deltas"][held["seen"] - 1]

    def release(self, name: str) -> None:
        self.tables.pop(name)["rows"].unpersist()


def unique_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"
