"""Suffix-array dedup of repeated byte strings by longest previous factors.

A string of ``length`` bytes that occurs twice is found by anchors: of each window of 101 grams of 100 bytes (for 200
bytes), those with the least hash are anchors, so equal strings hold equal anchors at equal places.  Anchors are
counted over the corpus, and the neighbourhood of each (all strings that it anchors) is one text with one or several
positions; at all but its first position, the whole text has a previous factor.  The distinct neighbourhoods of an anchor
then meet in a task.  There they are concatenated in corpus order and suffix-sorted by their first ``length`` bytes
(prefix doubling, ties by position).  The previous and the next smaller position in suffix order are the two candidates
for a suffix's longest previous factor; if either shares ``length`` bytes, the suffix has an earlier match.

An anchor with more than MAX_GROUP distinct neighbourhoods is split: each neighbourhood is cut in two overlapping halves
by where strings begin, and the halves meet by the bytes that all strings of a half share, which are 150 of 200 then, 175
in the next round, and so on, until groups are small or the strings of a group are all one.  So no group is ever too
large for a task, and every match is found by the same steps.

By default all copies go: those with an earlier match, and the earlier matches themselves.  With ``keep_first`` the first
copy stays, as only positions with an earlier match are removed.

Defined results: a null text is empty; matches never cross documents; rows repeated with one id, or without one, are
documents of their own; an empty table gives no rows; columns but doc_id and text are not read, whatever their names; a
very long text is worked on in pieces of PIECE bytes, and held whole only where its spans are cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, attach, saved, small_batches, to_batch, union

LENGTH = 200
MAX_GROUP = 20_000
CHUNK = (1 << 21) - 1
PIECE = 1 << 22


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of width values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class Anchors:
    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.gram = length, length // 2
        self.reach = length - self.gram  # how far a string may begin before its anchor
        self.rolling = Rolling()

    def bounds(self, at, n):
        """The neighbourhood of an anchor: all strings that hold it."""
        return np.maximum(at - self.reach, 0), np.minimum(at + self.length, n)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes of the grams there, hashes of the neighbourhoods (with the anchor's place in them)."""
        n, edge = len(data), 2 * self.length
        if n <= PIECE + 2 * edge:
            return self._within(data, 0, 0, n)
        # an anchor follows from less than ``edge`` bytes on each side
        parts = [self._within(data[max(0, s - edge) : s + PIECE + edge], max(0, s - edge), s, s + PIECE) for s in range(0, n, PIECE)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _within(self, data: bytes, start: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors at first..last-1 of a text of which data, from start on, is a part."""
        n = len(data)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        prefix = self.rolling.prefix(np.frombuffer(data, np.uint8))
        at = np.arange(n - self.gram + 1)
        grams = self.rolling.hashes(prefix, at, at + self.gram)
        width = self.reach + 1
        least = sliding(grams, width, np.minimum)
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        at = np.flatnonzero(sliding(padded, width, np.maximum)[: len(grams)] == grams)
        at = at[(at + start >= first) & (at + start < last)]
        lo, hi = self.bounds(at, n)
        around = self.rolling.hashes(prefix, lo, hi) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return at + start, grams[at].view(np.int64), around.view(np.int64)


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes by their first ``depth`` bytes, ties by position, and which equal the one before."""
    n = len(data)
    bits = np.uint64(max(8, n.bit_length()))
    place = np.arange(n, dtype=np.uint64)

    def ranked(key):  # key < 2**(2 bits)
        if 3 * int(bits) <= 64:  # key and place fit in one integer, which sorts several times as fast
            packed = np.sort(key << bits | place)
            order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            top = packed >> bits
        else:
            order = np.argsort(key, kind="stable")
            top = key[order]
        new = np.concatenate([[True], top[1:] != top[:-1]]) if n else np.zeros(0, bool)
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        return rank, order, new

    have = min(2 * int(bits) // 8, depth)
    padded = np.concatenate([data, np.zeros(have, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(have):
        key = key << np.uint64(8) | padded[i : i + n]
    rank, order, new = ranked(key)
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, np.uint64)
        after[: max(0, n - step)] = rank[step:]
        rank, order, new = ranked(rank << bits | after)
        have += step
    return order, ~new


def previous_smaller(position: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each element the nearest one before it, in its run, with a smaller position; -1 if there is none."""
    near = np.arange(-1, len(position) - 1)
    near[run != np.concatenate([[-1], run[:-1]])] = -1
    todo = np.flatnonzero(near >= 0)
    while len(todo):
        todo = todo[position[near[todo]] >= position[todo]]
        near[todo] = near[near[todo]]  # all between these two are no smaller than the first, so than the element
        todo = todo[near[todo] >= 0]
    return near


def previous_factors(texts: list[bytes], at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the concatenation) whose longest previous factor has ``depth`` bytes or more; and where one begins.

    at: the corpus position of each text's start, in rising order; starts at one corpus position are one.  The longest
    previous factor begins at the previous or at the next smaller position in suffix order.  Only whether it reaches
    ``depth`` is asked, so suffixes are ordered by so many bytes, and runs that share them are looked at.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    order, same = suffix_ranks(data, depth)
    inside = np.arange(len(data)) - np.repeat(first, sizes)
    usable = (inside + depth <= np.repeat(sizes, sizes))[order]
    run, order = np.cumsum(~same)[usable], order[usable]
    several = np.bincount(run, minlength=1)[run] > 1
    run, order = run[several], order[several]
    position = (np.repeat(at, sizes) + inside)[order]
    before = previous_smaller(position, run)
    after = len(run) - 1 - previous_smaller(position[::-1], run[::-1])[::-1]  # len(run) if there is none
    factor = np.where(before >= 0, before, after)
    matched = factor < len(run)
    return order[matched], order[factor[matched]]


def _found(docs: DataFrame, id_col: str, length: int) -> DataFrame:
    schema = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("gram", pa.int64()), ("around", pa.int64())])

    def work(batches):
        anchors = Anchors(length)
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, gram, around = anchors.of(text or b"")
                out.append((np.full(len(at), i, np.int64), at.astype(np.int32), gram, around))
            yield to_batch(schema, {c: np.concatenate(x) for c, x in zip(schema.names, zip(*out))} if out else {c: [] for c in schema.names})

    return docs.select(F.col(id_col).alias("doc"), F.col("text").cast("binary")).mapInArrow(work, "doc long, pos int, gram long, around long")


def _neighbourhoods(docs: DataFrame, id_col: str, open_: DataFrame, length: int) -> DataFrame:
    """The bytes around the anchors of open_ (doc, pos, gram, copies, hot); place: of the anchor in them."""
    lists = open_.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("pos", "gram", "copies", "hot")).alias("anchors"))
    met = docs.join(lists, docs[id_col] == lists["__doc"]).select(F.col("__doc").alias("doc"), F.col("text").cast("binary"), "anchors")
    schema = pa.schema([("doc", pa.int64()), ("gram", pa.int64()), ("copies", pa.int64()), ("hot", pa.bool_()), ("start", pa.int64()), ("place", pa.int64()), ("data", pa.binary())])

    def work(batches):
        anchors = Anchors(length)
        for b in batches:
            rows = []
            for doc, text, held in zip(*(b.column(i).to_pylist() for i in range(3))):
                for a in held:
                    lo, hi = anchors.bounds(a["pos"], len(text))
                    rows.append((doc, a["gram"], a["copies"], a["hot"], int(lo), int(a["pos"] - lo), text[lo:hi]))
                    if len(rows) == 10_000:
                        yield to_batch(schema, dict(zip(schema.names, zip(*rows))))
                        rows = []
            if rows:
                yield to_batch(schema, dict(zip(schema.names, zip(*rows))))

    return met.mapInArrow(work, "doc long, gram long, copies long, hot boolean, start long, place long, data binary")


SPAN = "doc long, lo long, hi long"


def _runs(doc: np.ndarray, start: np.ndarray, length: int):
    """Spans of the strings at start, those that touch or overlap as one."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)]) if len(doc) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1 if len(doc) else head
    return doc[head], start[head], start[tail] + length


def _by_suffixes(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    schema = pa.schema([("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def settle(held):
        held.sort(key=lambda r: (r[0], r[2]))
        docs = np.unique([r[0] for r in held])
        at = np.searchsorted(docs, [r[0] for r in held]).astype(np.int64) << 40 | np.array([r[2] for r in held])
        hits, sources = previous_factors([r[3] for r in held], at, length)
        marked = hits if keep_first else np.unique(np.concatenate([hits, sources]))
        sizes = np.array([len(r[3]) for r in held])
        first = np.cumsum(sizes) - sizes
        text = np.searchsorted(first, marked, "right") - 1
        if not keep_first:  # those that occur twice as a whole are settled
            lone = np.array([r[1] == 1 for r in held])[text]
            marked, text = marked[lone], text[lone]
        doc, lo, hi = _runs(np.array([r[0] for r in held], np.int64)[text], np.array([r[2] for r in held], np.int64)[text] + marked - first[text], length)
        return to_batch(schema, {"doc": doc, "lo": lo, "hi": hi})

    def work(batches):
        held, group, size, last = [], [], 0, None
        for b in batches:
            for doc, gram, copies, start, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                if gram != last:
                    more = sum(len(r[3]) for r in group)
                    if size + more > CHUNK // 2 and held:
                        yield settle(held)
                        held, size = [], 0
                    held += group
                    group, size, last = [], size + more, gram
                group.append((doc, copies, start, data))
        if held or group:
            for part in ([held + group] if size + sum(len(r[3]) for r in group) <= CHUNK else [held, group]):
                if part:
                    yield settle(part)

    dealt = rows.select("doc", "gram", "copies", "start", "data")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(work, SPAN)


def _halves(rows: DataFrame, length: int, first: int, last: int) -> DataFrame:
    """Of neighbourhoods whose strings begin first..last bytes before the anchor, those that begin closer, and farther.

    gram is then the hash of what all strings of the half share, around that of all bytes of the half.
    """
    kinds = [("doc", pa.int64()), ("copies", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("data", pa.binary()), ("gram", pa.int64()), ("around", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]
    schema, middle = pa.schema(kinds), (first + last) // 2

    def number(x: bytes, seed: int) -> int:
        return xxhash.xxh3_64_intdigest(x, seed) - (1 << 63)

    def work(batches):
        for b in batches:
            out = []
            for doc, copies, start, place, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                for a, z in ((first, middle), (middle + 1, last)):
                    lo, hi = max(0, place - z), min(len(data), place + length - a)
                    if hi - lo >= length:
                        shared = data[place - a : place + length - z]
                        out.append((doc, copies, start + lo, place - lo, data[lo:hi], number(shared, a * 2 * length + z), number(data[lo:hi], place - lo), a, z))
            if out:
                yield to_batch(schema, dict(zip(schema.names, zip(*out))))

    return rows.select("doc", "copies", "start", "place", "data").mapInArrow(work, "doc long, copies long, start long, place long, data binary, gram long, around long, first long, last long")


def _open(around: DataFrame, keep_first: bool) -> DataFrame:
    """gram, hot: grams with several distinct neighbourhoods, one of them with a single position or with one to keep."""
    lone = F.count(F.when(F.col("copies") == 1, 1))
    grams = around.groupBy("gram").agg(F.count("*").alias("kinds"), lone.alias("lone"))
    grams = grams.filter("kinds > 1" if keep_first else "kinds > 1 and lone > 0")
    return saved(grams.select("gram", (F.col("kinds") > MAX_GROUP).alias("hot")), "open_grams")


def _split(rows: DataFrame, length: int, first: int, last: int, keep_first: bool) -> list[DataFrame]:
    """Spans of what has too many distinct neighbourhoods; the ranges are halved until groups are small."""
    halves = saved(_halves(rows, length, first, last), "halves")
    place = F.struct("doc", "start")
    around = saved(halves.groupBy("gram", "around").agg(F.count("*").alias("n"), F.sum("copies").alias("all"), F.min(place).alias("one")), "halves_around")
    met = halves.join(around, ["gram", "around"])
    sure = met.filter("n > 1").filter(place != F.col("one") if keep_first else F.col("copies") == 1)
    out = [saved(sure.select("doc", F.col("start").alias("lo"), (F.col("start") + F.length("data")).alias("hi")), "spans")]
    grams = _open(around.select("gram", F.col("all").alias("copies")), keep_first)
    kept = met.filter(place == F.col("one")).select("doc", F.col("all").alias("copies"), "start", "place", "data", "gram", "first", "last")
    kept = saved(kept.join(grams, "gram"), "halves_open")
    out.append(_by_suffixes(kept.filter("not hot"), length, keep_first))
    middle = (first + last) // 2
    for a, z in ((first, middle), (middle + 1, last)):
        hot = kept.filter("hot").filter((F.col("first") == a) & (F.col("last") == z))
        if not hot.isEmpty():
            out += _split(hot, length, a, z, keep_first)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc, lo, hi: bytes of docs (ids unique, not null) that repeated strings cover; spans may overlap.

    Rows of frequent grams and neighbourhoods meet their groups by a broadcast of these, which are few.
    """
    small_batches(docs.sparkSession)
    found = saved(_found(docs, id_col, length), "found")
    twice = saved(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    held = saved(attach(found, twice, "gram", "n", found.count()).drop("n"), "anchors")
    first = F.min(F.struct("doc", "pos"))
    around = saved(held.groupBy("gram", "around").agg(F.count("*").alias("copies"), first.alias("first")), "around")
    reach = length - length // 2
    whole = F.struct("gram", "around").alias("whole")
    sure = attach(held.select("doc", "pos", whole), around.filter("copies > 1").select(whole, "copies", "first"), "whole", "copies", held.count())
    if keep_first:
        sure = sure.filter(F.struct("doc", "pos") != F.col("first"))
    sure = sure.select("doc", F.greatest(F.col("pos").cast("long") - reach, F.lit(0)).alias("lo"), (F.col("pos").cast("long") + length).alias("hi"))
    open_ = around.join(_open(around, keep_first), "gram").select(F.col("first.doc").alias("doc"), F.col("first.pos").alias("pos"), "gram", "copies", "hot")
    rows = saved(_neighbourhoods(docs, id_col, saved(open_, "open"), length), "neighbourhoods")
    out = [sure, _by_suffixes(rows.filter("not hot"), length, keep_first)]
    hot = rows.filter("hot")
    if not hot.isEmpty():
        out += _split(hot, length, 0, reach, keep_first)
    return union(out)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes that are left if with_text."""
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    docs = docs.select("doc_id", "text")
    if ids.n != ids.d:  # repeated or null ids
        docs = saved(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        docs = docs.withColumn("row", F.col("doc_id"))
    spans = repeated_spans(docs, "row", length, keep_first)
    each = spans.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    met = docs.join(each, docs["row"] == each["__doc"], "left").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "spans")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def work(batches):
        for b in batches:
            rows = []
            for doc, text, held in zip(*(b.column(i).to_pylist() for i in range(3))):
                runs = []
                for s in sorted((s["lo"], min(s["hi"], len(text))) for s in held or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], s[1]))
                    else:
                        runs.append(s)
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
                rows.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)[: len(schema)])
            yield to_batch(schema, dict(zip(schema.names, zip(*rows)))) if rows else to_batch(schema, {c: [] for c in schema.names})

    return met.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
