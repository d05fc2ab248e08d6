"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table of (digest, keep_id, batch) in buckets sorted by digest.  A batch's digests are aggregated map-side
to one row per text, anti-joined with the index by sort-merge, and what is new is appended; what stays is then read from
the index by a merge join.  The index side is never shuffled, and not sorted again either where a bucket is one file.  A
bucket that has gathered FILES files, or more than ``per_bucket`` digests, is mended by writing the index anew, with
twice the buckets if need be; the new generation counts once ``index.json`` names it.  Texts never leave the scan.

A batch has an id, by default a digest of its rows.  Adding a batch again, after whatever failure, gives the result of
the first time, as rows of the same batch in the index do not count as known and are not appended twice.  So the same rows
under the same id are one batch; give ids of your own to have them judged as new ones.  One writer at a time is meant.

Defined results: a null text counts as empty; texts are equal if identical after replacing each run of white
space by one space; the smallest id stays (nulls last), and of rows repeated with that id one stays; a text that
the index already had keeps the id it had and none of the batch stays; an empty table gives no rows; columns but the id
and the text are not read, whatever their names; a very long text is hashed whole by one task.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Files
from .common import SPACE, attach, row_key, saved, scratch, without

#: Files of a bucket, beyond which the index is written anew.
FILES = 8
#: Lets a scan of one file a bucket keep the file's order.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class DigestIndex:
    """An index at ``path``; opening the same path again, in any session, continues it."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16, per_bucket: int = 1_000_000) -> None:
        self.spark, self.path, self.per_bucket = spark, (path or scratch(spark, "digests")).rstrip("/"), per_bucket
        self.files = Files(spark, self.path)
        text = self.files.read("index.json")
        self.meta = json.loads(text) if text else {"generation": 0, "buckets": buckets}
        self._declare()
        if not text:
            self._note()

    def _note(self) -> None:
        self.files.replace("index.json", json.dumps(self.meta))

    def _folder(self) -> str:
        return f"generation-{self.meta['generation']}"

    def _declare(self) -> None:
        self.name = f"digest_index_{uuid.uuid4().hex}"
        n = self.meta["buckets"]
        self.spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{self.path}/{self._folder()}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """One file for each bucket and call, as rows are dealt by the hash that buckets use."""
        n = self.meta["buckets"]
        dealt = new.select("digest", "keep_id", "batch").repartition(n, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(n, "digest").sortBy("digest").option("path", f"{self.path}/{self._folder()}").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def make_room(self, more: int) -> None:
        """Before ``more`` digests come: enough buckets, of few files each."""
        have = self.rows().count()
        n, old = self.meta["buckets"], self._folder()
        while n * self.per_bucket < have + more:
            n *= 2
        files = len(self.files.parquet(old)) if have else 0
        if n == self.meta["buckets"] and files <= FILES * n:
            return
        rows, before = self.rows(), self.name
        self.meta = {"generation": self.meta["generation"] + 1, "buckets": n}
        self.files.delete(self._folder())  # what an earlier attempt left
        self._declare()
        if have:
            self.append(rows)
        self._note()
        self.spark.sql(f"DROP TABLE {before}")
        self.files.delete(old)

    def unknown(self, groups: DataFrame, batch: str) -> DataFrame:
        """Rows of groups whose digest no other batch has brought."""
        return groups.join(self.rows().filter(F.col("batch") != batch).hint("merge"), "digest", "left_anti")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Dedup a batch and append its new digests: doc_id, keep_id, group_size (in the batch), kept, text_sha256, key (see row_key)."""
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
        # the row number tells repeated rows apart; it is stable once written
        digests = saved(docs.select("doc_id", row_key().alias("key"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "batch")
        n_rows, mark = digests.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)"))).first()
        batch = batch or f"{n_rows}:{mark}"
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
        groups = saved(digests.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")).select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "groups")
        self.make_room(groups.count())
        before = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            own = self.rows().filter(F.col("batch") == batch).hint("merge")  # of an earlier attempt
            fresh = saved(self.unknown(groups, batch).join(own, "digest", "left_anti").withColumn("batch", F.lit(batch)), "fresh")
            self.append(fresh)
            held = self.rows().select("digest", F.col("keep_id").alias("known_id"), (F.col("batch") == batch).alias("own"))
            met = groups.join(held.hint("merge"), "digest").select("digest", F.col("known_id").alias("keep_id"), F.when(F.col("own"), F.col("keep_row")).otherwise(-1).alias("keep_row"), "group_size")
            met = saved(met, "met")
        finally:
            self.spark.conf.set(ORDERED, before)
        out = attach(digests, met, "digest", "group_size", n_rows)
        return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "key")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    return (index or DigestIndex(docs.sparkSession)).add(docs).drop("key")


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeated with one id and text, one stays."""
    return without(docs, (index or DigestIndex(docs.sparkSession)).add(docs), "gone")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
