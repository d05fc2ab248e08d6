"""Pattern packing by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths (at most ``capacity``
counts) comes to the driver.  There, all patterns of at most three lengths that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares, rounded by carrying fractions along,
and what is left over is packed best-fit decreasing, whole runs of equal pieces at a time.  Each piece finds its
sequence by its rank among the pieces of its length, so no task sees all pieces of a length.

Patterns and their fit live on the driver and are about a twelfth of the square of the capacity: 350,000 at 2,048, which
is what this is meant for; from 16,384 on (22 million), pack by bestfit.py instead.

Defined results: a null text counts as empty and packs as the end id alone; repeated rows and those without an id are
packed each; pieces of one length are placed in the order of id, piece and checksum; an empty table gives no rows;
columns but doc_id and text are not read, whatever their names; a very long text is held whole by one worker with its ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, saved, small_batches, to_batch
from .tokenizing import DEFAULT, worker_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; the first takes what full ones leave."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str = DEFAULT, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = worker_encoder(tokenizer)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = memoryview(encoder.of(text) + end)
                rows += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(piece_bounds(len(ids) // 4, capacity))]
            yield to_batch(schema, dict(zip(schema.names, zip(*rows)))) if rows else to_batch(schema, {n: [] for n in schema.names})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """All ways to fill a sequence with two or three of the lengths present; absent third lengths are 0."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    out = []
    for a in present[::-1]:
        left = capacity - a
        b = present[(present <= min(a, left)) & (present * 2 >= left)]
        c = left - b
        ok = (c == 0) | have[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(columns: np.ndarray, histogram: np.ndarray, steps: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 with least squared distance of the lengths used from the histogram, by accelerated projected gradients."""
    size = len(histogram)
    flat = columns.T.reshape(-1)

    def used(x):
        out = np.bincount(flat, np.tile(x, columns.shape[1]), size)
        out[0] = 0
        return out

    def back(r):
        return r[columns].sum(1)

    v = np.ones(len(columns))
    for _ in range(8):
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(used(v))))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y + step * back(histogram - used(y)))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def rounded(columns: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that use no length more often than it occurs."""
    whole = np.diff(np.floor(np.cumsum(x) + 1e-9), prepend=0).astype(np.int64)
    left, runs = histogram.copy(), []
    for i in np.flatnonzero(whole):
        pattern = [int(v) for v in columns[i] if v]
        n = int(min(whole[i], *(left[v] // pattern.count(v) for v in pattern)))
        if n > 0:
            runs.append((tuple(pattern), n))
            for v in pattern:
                left[v] -= n
    return runs


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: the same bins as one piece at a time, but whole runs at once."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern, n):
        room = capacity - sum(pattern)
        if not room:
            done.append((pattern, n))
        elif room in open_:
            open_[room].append((pattern, n))
        else:
            open_[room] = [(pattern, n)]
            insort(rooms, room)

    for length in map(int, np.flatnonzero(histogram)[::-1]):
        left = int(histogram[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                bins, over = divmod(left, each)
                if bins:
                    put((length,) * each, bins)
                if over:
                    put((length,) * over, 1)
                break
            room = rooms[at]
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // length
            bins = min(n, left // each)
            if bins:
                put(pattern + (length,) * each, bins)
                left -= bins * each
            if bins < n:
                if left and left < each:
                    put(pattern + (length,) * left, 1)
                    bins, left = bins + 1, 0
                if bins < n:
                    put(pattern, n - bins)
    return done + [x for group in open_.values() for x in group]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use each length exactly as often as it occurs."""
    full = [((capacity,), int(histogram[capacity]))] if histogram[capacity] else []
    rest = histogram.astype(np.int64).copy()
    rest[capacity] = rest[0] = 0
    columns = patterns(capacity, np.flatnonzero(rest))
    x = fit(columns, rest.astype(float)) if len(columns) else np.zeros(0)
    best = None
    for share in SHARES:
        runs = rounded(columns, x * share, rest)
        left = rest.copy()
        for pattern, n in runs:
            for v in pattern:
                left[v] -= n
        runs += best_fit(left, capacity)
        if best is None or sum(n for _, n in runs) < sum(n for _, n in best):
            best = runs
    return full + (best or [])


def pack(docs: DataFrame, tokenizer: str = DEFAULT, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = saved(pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        histogram[r.length] = r["count"]
    # slots of a length in rank order: first rank, sequence of that rank, offset in the sequence
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(capacity + 1, np.int64)
    base = 0
    for pattern, n in plan(histogram, capacity):
        offset = 0
        for v in pattern:
            slots.setdefault(v, []).append((int(taken[v]), base, offset))
            taken[v] += n
            offset += v
        base += n
    if (taken != histogram).any():
        raise AssertionError("the plan does not use each piece once")
    table = docs.sparkSession.sparkContext.broadcast({v: np.array(x, np.int64).T for v, x in slots.items()})
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                own = length == v
                first, at, off = table.value[int(v)]
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = at[i] + rank[own] - first[i], off[i]
            yield to_batch(schema, {n: b.column(n) for n in schema.names[:5]} | {"sequence_id": sequence, "offset": offset})

    spots = ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], int(histogram.sum()), buckets=64)
    return spots.mapInArrow(place, PIECES + ", sequence_id long, offset long")
