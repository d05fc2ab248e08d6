"""What the operators of this subpackage share: scratch tables, hot-key joins, packed bytes."""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.recursion import shared_dir

#: White space that separates words; every other code point belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key that holds more than one row in HOT_SHARE is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Bound the session's Arrow batches by rows and bytes, as one row may hold a very long text; smaller bounds stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: Deletes a statement's shuffle files once it has ended; what lost executors held is made again while it runs.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written to the shared folder and read again, so a lost executor costs no earlier stage.

    The write's shuffle files go when it has ended, as nothing reads them any more.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """Join rows to groups (one row per key, ``size`` rows each) whatever the skew.

    Groups of more than n_rows / HOT_SHARE rows are at most HOT_SHARE, so they are broadcast; the others meet
    their rows in an ordinary join, in which no key is hot.
    """
    limit = max(1, n_rows // HOT_SHARE)
    own = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.filter(F.col(size) > limit).select(key, F.struct(*own).alias("__hot")))
    split = rows.join(hot, key, "left")
    met = split.filter("__hot is not null").select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in own])
    cold = split.filter("__hot is null").drop("__hot").join(groups.filter(F.col(size) <= limit), key, how)
    return met.unionByName(cold.select(*rows.columns, *own))


def row_key() -> Column:
    """One number for a row's id and text, never null; rows that share it without sharing the id are told apart by the id."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def reading_parts(spark: SparkSession, files: int, each: int) -> int:
    """Partitions to read so many files in, some to a task, and no more than the cluster can use: tasks read one file after another."""
    return max(1, min(math.ceil(files / each), 32 * spark.sparkContext.defaultParallelism))


def without(docs: DataFrame, judged: DataFrame, name: str) -> DataFrame:
    """The rows of docs that stay.  judged has doc_id, key (see row_key) and kept for every row.

    Of n equal rows as many stay as judged keeps; the texts are shuffled once, by the same plan at every size.
    """
    votes = judged.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.count_if(F.col("kept")).alias("__kept"), F.count_if(~F.col("kept")).alias("__not"))
    gone = saved(votes.filter("__not > 0"), name)

    def same(some: DataFrame):
        return (row_key() == some["__key"]) & docs["doc_id"].eqNullSafe(some["__id"])

    rest = docs.join(gone.hint("merge"), same(gone), "left_anti")
    again = gone.filter("__kept > 0")
    if again.isEmpty():
        return rest
    # some of equal rows stay: they differ at most in other columns
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    met = docs.select(F.struct(*columns).alias("__row"), row_key().alias("__k"), docs["doc_id"].alias("__d")).join(again.hint("merge"), (F.col("__k") == F.col("__key")) & F.col("__d").eqNullSafe(F.col("__id")))
    nth = F.row_number().over(Window.partitionBy("__key", "__id").orderBy(F.to_json("__row")))
    some = met.withColumn("__nth", nth).filter("__nth <= __kept")
    return rest.unionAll(some.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def ranked(rows: DataFrame, key: str, order: list[str], n_rows: int, size: str | None = None, ties: list[str] = [], buckets: int = 256) -> DataFrame:
    """Add ``rank`` (from 0 within key; with ``size``, the sum of that column before the row).

    No task gets a whole key: each key is dealt into buckets by a hash of the order columns, ranks run inside a
    bucket, and bucket totals (at most one row for each key and bucket) give where each bucket begins.  ``ties``
    orders rows that are equal otherwise.  Ranks follow from the rows alone, not from how they are split or shuffled.
    """
    buckets = max(buckets, math.ceil(n_rows / 20_000))
    amount = F.col(size).cast("long") if size else F.lit(1).cast("long")
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(key, "__bucket").orderBy(*order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "__bucket").agg(F.sum(amount).alias("__n"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(key).alias("__key"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = dealt.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = placed.join(starts, placed[key].eqNullSafe(starts["__key"]) & (placed["__bucket"] == starts["__b"]))
    return joined.select(*rows.columns, (F.col("__start") + F.col("__in")).cast("long").alias("rank"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def to_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """64-bit hashes of any byte ranges of a buffer, from prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.power = self.inverse = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if n > len(self.power):
            size = max(n, 2 * len(self.power))
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.power[: n - 1], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Equal ranges have equal hashes; the length is part of the hash."""
        return mixed((prefix[hi] - prefix[lo]) * self.inverse[lo] + mixed((hi - lo).astype(np.uint64)))
