"""Token counts by a two-tier lookup.

Tier one is a compact hash table of the token counts of the corpus's frequent stretches between spaces (see
tokenizing.py), broadcast to all workers: ``size`` entries of 20 bytes, at half load, so some 3 MB.  Keys are the
stretches themselves, of at most 16 bytes, so no hash decides; a text's stretches are looked up all at once.  Tier two
encodes what the table lacks and keeps it in the worker's own bounded cache.

Frequencies are counted over all documents, each task keeping a bounded summary of its most frequent stretches; only
the summaries' ``summary`` first entries are merged, so no stretch of a text is ever shuffled.  The table saves time
only: whatever it lacks or misjudges is counted exactly by tier two.

Defined results: a null text counts as empty (0 bytes, 0 tokens); strings of special tokens inside a text are
handled as the library does by default; every row of the input gives one row, repeated ones and those without an id too;
an empty table gives no rows; columns but doc_id and text are not read, whatever their names; a very long text is held
whole by one worker, with some 60 bytes for each of its words.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, to_batch
from .tokenizing import DEFAULT, library, worker_encoder

WIDTH = 16
#: Bytes of texts that are looked up at once.
TOGETHER = 1 << 20


class Lengths:
    """An open-addressing table from stretches of 1 to WIDTH bytes to small numbers."""

    def __init__(self, words: list[str], numbers: list[int]) -> None:
        held = [(w, n) for w, n in zip((w.encode() for w in words), numbers) if 0 < len(w) <= WIDTH]
        self.mask = (1 << max(4, (2 * len(held)).bit_length())) - 1
        self.head, self.tail = (np.zeros(self.mask + 1, np.uint64) for _ in range(2))
        self.size, self.number = np.zeros(self.mask + 1, np.uint8), np.zeros(self.mask + 1, np.uint16)
        self.probes = 0
        if not held:
            return
        data = b" ".join(w for w, _ in held)
        size = np.array([len(w) for w, _ in held])
        start = np.cumsum(size + 1) - size - 1
        head, tail, at = self.keys(self.padded(data), start, size)
        number = np.array([n for _, n in held], np.uint16)
        todo = np.arange(len(held))
        while len(todo):
            place = (at[todo] + self.probes) & self.mask
            _, first = np.unique(place, return_index=True)
            mine = todo[first[self.size[place[first]] == 0]]
            to = (at[mine] + self.probes) & self.mask
            self.head[to], self.tail[to], self.size[to], self.number[to] = head[mine], tail[mine], size[mine], number[mine]
            todo = np.setdiff1d(todo, mine, assume_unique=True)
            self.probes += 1

    @staticmethod
    def padded(data: bytes) -> np.ndarray:
        """The eight bytes that begin at each place, and WIDTH places before the first."""
        raw = b"\0" * WIDTH + data + b"\0" * WIDTH
        return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))

    def keys(self, windows: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last eight bytes of each stretch (shorter ones shifted), which with its size are the stretch, and its slot."""
        lost = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
        head = windows[start + WIDTH] << lost
        tail = windows[start + size + WIDTH - 8] >> lost
        h = (head ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F)) ^ size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return head, tail, (h >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, windows: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each stretch of 1 to WIDTH bytes; -1 if the table lacks it."""
        out = np.full(len(start), -1, np.int64)
        head, tail, at = self.keys(windows, start, size)
        todo = np.arange(len(start))
        for probe in range(self.probes):
            place = (at[todo] + probe) & self.mask
            same = (self.head[place] == head[todo]) & (self.tail[place] == tail[todo]) & (self.size[place] == size[todo])
            out[todo[same]] = self.number[place[same]]
            todo = todo[~same & (self.size[place] > 0)]
            if not len(todo):
                break
        return out


def frequent_counts(docs: DataFrame, tokenizer: str = DEFAULT, size: int = 65_536, summary: int = 16_384) -> Lengths:
    """The table of the corpus's most frequent stretches."""

    def tally(batches):
        seen: Counter = Counter()
        lost = 0  # what a stretch that is not in the summary may have been seen more often, at most
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(t.split(" ")[1:])
            if len(seen) > 32 * summary:
                least = int(np.partition(np.fromiter(seen.values(), np.int64, len(seen)), -8 * summary)[-8 * summary])
                lost += least
                seen = Counter({w: n - least for w, n in seen.items() if n > least})
        short = ((w, n + lost) for w, n in seen.items() if len(w) <= WIDTH and 0 < len(w.encode("utf-8", "surrogatepass")) <= WIDTH)
        top = heapq.nlargest(summary, short, key=lambda x: (x[1], x[0]))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    merged = docs.select("text").filter("text is not null").mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r.word for r in merged.orderBy(F.desc("n"), "word").limit(size).collect()]
    # a stretch with white space at an end is never looked up, so its count may stand here without harm
    return Lengths(words, [len(x) for x in library(tokenizer).encode_batch_fast([" " + w for w in words], add_special_tokens=False)])


def token_counts(docs: DataFrame, tokenizer: str = DEFAULT, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(frequent_counts(docs, tokenizer))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches):
        encoder, lengths = worker_encoder(tokenizer, True), table.value

        def together(texts: list[bytes]) -> np.ndarray:
            """Of texts without odd spaces: all their stretches are looked up at once."""
            data = b" ".join(texts)
            length = np.array([len(t) for t in texts])
            begin = np.cumsum(length + 1) - length - 1
            gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
            start, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
            size, text = end - start, np.searchsorted(begin, start, "right") - 1
            head = start == begin[text]  # no space of the text's own is before it
            found = np.where(head, 0, -1)
            fits = ~head & (size > 0) & (size <= WIDTH)
            found[fits] = lengths.find(lengths.padded(data), start[fits], size[fits])

            def cut(at: np.ndarray) -> list[str]:
                return [data[a:z].decode("utf-8", "surrogatepass") for a, z in zip(start[at].tolist(), end[at].tolist())]

            lost, first = np.flatnonzero(found < 0), np.flatnonzero(head & (size > 0))
            if len(lost):
                found[lost] = encoder.stretches(cut(lost))
            if len(first):
                found[first] = encoder.encode(cut(first))
            return np.bincount(text, found, len(texts)).astype(np.int64)

        for b in batches:
            n, held, at, size = np.zeros(b.num_rows, np.int64), [], [], 0
            for i, text in enumerate(b.column(1).to_pylist()):
                if text and encoder.odd(text):
                    n[i] = encoder.of(text)
                elif text:
                    held.append(text.encode("utf-8", "surrogatepass"))
                    at.append(i)
                    size += len(held[-1])
                if held and (size > TOGETHER or i + 1 == b.num_rows):
                    n[at] = together(held)
                    held, at, size = [], [], 0
            yield to_batch(schema, {"doc_id": b.column(0), "n_bytes": b.column(2), "n_tokens": n, "over_limit": n > limit})

    source = docs.select(F.col("doc_id").cast("long"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return source.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
