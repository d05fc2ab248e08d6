"""Mixing sources to target weights by blocks.

The words of a source's documents, one document after another, are packed into blocks of ``block`` words.  The mix
is a list of slots in output shards.  A shard draws how many of its slots each source gets: the whole part of the
expected numbers, and the rest multinomially.  A source's slots are numbered over all shards; slot k takes block
permutation(k mod blocks) of the source, where each pass over a source has a pseudorandom index permutation of its
own (a Feistel network with cycle walking).  Slots and blocks are then joined by source and block index, so no source,
however large, meets in one task.

Defined results: a null text has size 0 and gives nothing; null is a source of its own, the last; a source without
words has target 0; a block is taken at most twice (slots that would go further stay empty), so no document exceeds
twice its size; repeated rows are mixed each; an empty table gives no rows; columns but doc_id, text and source are not
read, whatever their names; of a very long text only the size and then the parts taken leave its row.  Documents follow
one another by hashes of id and text, so the mix is a function of the rows: it does not change with the files, their
splits or the cluster.  The number of sources is a bounded parameter (MAX_SOURCES; more raise an error), as the weights
are given for each of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, ranked, row_key, saved, small_batches, to_batch

WEIGHTS, SHARE, LIMIT, BLOCK, SHARD = (3.0, 1.0, 2.0), 1.5, 2.0, 64, 1 << 16
MAX_SOURCES = 100_000
SEED = 20_240_229
#: Slots that a task spreads, about.
SPREAD = 1 << 18


def targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Weights share ``share`` of all sizes; none goes over ``limit`` times its size, the excess being shared again."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = limit * float(sizes[i])
        open_ -= set(over)
        rest -= sum(out[i] for i in over)
    return out


def scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at k: a Feistel network over an even number of bits, walked until below n."""
    half = np.uint64(max(1, math.ceil(max(n - 1, 1).bit_length() / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        x = out[todo]
        a, b = x >> half, x & mask
        for r in range(4):
            a, b = b, a ^ (scramble(b, (key * 4 + r) & ((1 << 63) - 1)) & mask)
        out[todo] = (a << half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_counts(expected: np.ndarray, slots: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of a shard's slots each source gets; expected shares sum to 1."""
    mean = expected * slots
    whole = np.floor(mean + 1e-9).astype(np.int64)
    rest = np.maximum(mean - whole, 0)
    if slots > whole.sum():
        whole += np.random.default_rng(seed).multinomial(slots - whole.sum(), rest / rest.sum() if rest.sum() > 0 else expected)
    return whole


class Mix:
    """The mix of docs: ``sources``, ``sized`` (a row for each document), ``slots`` and ``segments``."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> None:
        spark = docs.sparkSession
        small_batches(spark)
        size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
        sized = saved(docs.select("doc_id", F.col("source").cast("string"), size.alias("size"), row_key().alias("key")).withColumn("row", F.monotonically_increasing_id()), "sizes")
        found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
        goal = targets([r.n for r in found], [weights[i % len(weights)] for i in range(len(found))], share, limit)
        self.block, self.rows = block, sum(r.rows for r in found)
        table = [(i, r.source, r.n, t, max(1, math.ceil(r.n / block)) if r.n else 0) for i, (r, t) in enumerate(zip(found, goal))]
        self.sources = spark.createDataFrame(table, "s int, source string, source_size long, target double, blocks long")
        named = F.broadcast(self.sources.select("s", F.col("source").alias("__source")))
        self.sized = saved(sized.join(named, sized["source"].eqNullSafe(named["__source"])).drop("__source"), "sized")
        # a block of a source holds source_size / blocks words on average
        want = np.array([t * b / n if n else 0.0 for _, _, n, t, b in table])
        blocks = np.array([b for *_, b in table], np.int64)
        total = round(want.sum())
        self.slots = self._slots(spark, want / max(want.sum(), 1e-9), blocks, total, shard, seed, limit)
        self.segments = self._segments()

    def _slots(self, spark, expected, blocks, total, shard, seed, limit) -> DataFrame:
        shards = math.ceil(total / shard)
        each = spark.sparkContext.broadcast((expected, blocks))
        counts_schema = pa.schema([("s", pa.int32()), ("shard", pa.int64()), ("n", pa.int64())])

        def count(batches):
            p, _ = each.value
            for b in batches:
                for j in b.column(0).to_pylist():
                    n = shard_counts(p, total // shards + (j < total % shards), (seed, j))
                    some = np.flatnonzero(n)
                    yield to_batch(counts_schema, {"s": some.astype(np.int32), "shard": np.full(len(some), j), "n": n[some]})

        counts = spark.range(shards).mapInArrow(count, "s int, shard long, n long")
        counts = saved(counts, "shard_counts")
        slot_schema = pa.schema([("s", pa.int32()), ("shard", pa.int64()), ("slot", pa.int64()), ("pass", pa.int32()), ("block", pa.int64())])

        def spread(batches):
            _, most = each.value
            for b in batches:
                for s, j, n, first in zip(*(b.column(c).to_pylist() for c in ("s", "shard", "n", "rank"))):
                    k = np.arange(first, min(first + n, int(limit * most[s])))
                    turn = k // most[s]
                    at = np.concatenate([permuted(k[turn == t] % most[s], int(most[s]), hash_key(seed, s, int(t))) for t in np.unique(turn)]) if len(k) else k
                    yield to_batch(slot_schema, {"s": np.full(len(k), s, np.int32), "shard": np.full(len(k), j), "slot": k, "pass": turn.astype(np.int32), "block": at})

        first = ranked(counts, "s", ["shard"], max(1, shards), "n", buckets=16)
        # the rows are few, but each stands for up to a shard of slots
        first = first.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SPREAD)), "s", "shard")
        return first.mapInArrow(spread, "s int, shard long, slot long, pass int, block long")

    def _segments(self) -> DataFrame:
        """s, block, row, first word and number of words: what of each document is in which block."""
        b = self.block
        placed = ranked(self.sized.filter("size > 0").select("s", "row", "size", "key", "doc_id"), "s", ["key", "doc_id"], self.rows, "size", ["row"])
        cut = placed.select("s", "row", "size", "rank", F.explode(F.expr(f"sequence(rank div {b}, (rank + size - 1) div {b})")).alias("block"))
        low, high = F.greatest("rank", F.col("block") * b), F.least(F.col("rank") + F.col("size"), (F.col("block") + 1) * b)
        return cut.select("s", "block", "row", (low - F.col("rank")).alias("first"), (high - low).alias("n"))

    def taken(self) -> DataFrame:
        """The mix itself: every slot with the document parts that fill it.  Neither side is small, whatever estimates say."""
        return self.slots.join(self.segments.hint("merge"), ["s", "block"])

    def report(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken of every row."""
        words = self.taken().groupBy("row").agg(F.sum("n").alias("taken"))
        rows = self.sized.join(words, "row", "left").join(F.broadcast(self.sources.drop("source", "blocks")), "s")
        return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mixed documents, with the columns of docs: for each pass over a source a row for each document that it
        takes words of, its text cut down to those words.  Of rows with equal ids and texts, that with the least other
        columns (as JSON) stands for all."""
        key = self.sized.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "row")
        parts = self.taken().groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("__parts"))
        parts = saved(key.join(parts, "row").select("__id", "__key", "__parts"), "parts")
        rest = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in ("text", "n_chars")])
        once = docs.select(docs["doc_id"].alias("__d"), row_key().alias("__k"), docs["text"].alias("__text"), rest.alias("__rest"))
        if self.sized.select("doc_id", "key").distinct().count() < self.rows:
            once = once.groupBy("__d", "__k").agg(F.first("__text").alias("__text"), F.min_by("__rest", F.to_json("__rest")).alias("__rest"))
        met = once.join(parts.hint("merge"), (F.col("__k") == F.col("__key")) & F.col("__d").eqNullSafe(F.col("__id"))).select("__text", "__parts", "__rest")

        def cut(batches):
            for b in batches:
                texts = [sliced(t, p) for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(2)], ["__text", "__rest"])

        out = met.mapInArrow(cut, T.StructType([T.StructField("__text", T.StringType()), T.StructField("__rest", met.schema["__rest"].dataType)]))
        have = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
        return out.select(*[have.get(c, F.col("__rest").getField(c)).alias(c) for c in docs.columns])


def hash_key(seed: int, s: int, turn: int) -> int:
    return (seed * 1_000_003 + s) * 1_000_003 + turn


_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def sliced(text: str, parts: list[dict]) -> str:
    """The words [first, first + n) of each part, with what stands between them; runs that meet are joined."""
    data = text.encode("utf-8", "surrogatepass")
    blank = _space[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    runs: list[list[int]] = []
    for p in parts:
        if runs and runs[-1][1] == p["first"]:
            runs[-1][1] += p["n"]
        else:
            runs.append([p["first"], p["first"] + p["n"]])
    if runs == [[0, len(starts)]]:
        return text
    return b"\n".join(data[starts[a] : ends[b - 1]] for a, b in runs).decode("utf-8", "surrogatepass")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    return Mix(docs, **options).report()


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    return Mix(docs, **options).texts(docs)
