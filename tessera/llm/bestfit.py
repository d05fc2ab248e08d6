"""Best-fit-decreasing packing into binary token-id files.

Each input partition is packed by itself in batches of ``batch_tokens``, so nothing is shuffled and memory is
bounded.  In a batch, pieces go longest first into the sequence with the least room that still holds them, found in
a segment tree over rooms.  Overlong documents are cut into pieces without loss.  A file holds the id matrix, the
cumulative lengths of each sequence's segments, a bit for each position that resets to 0, and the piece table.

Files are named by partition and batch and appear by a rename, so a task that runs again writes the same files.
Defined results: a null text counts as empty and packs as the end id alone; every row is packed, repeated ones and those
without an id too; pieces of one length go in the order of the rows; an empty table gives no files and no rows; columns
but doc_id and text are not read, whatever their names; a very long text is held whole by one worker with its ids, and
ends the batch that it comes to.
"""

from __future__ import annotations

import io
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reading_parts, saved, scratch, small_batches, to_batch
from .tokenizing import DEFAULT, library, worker_encoder


#: Files that a task reads back, one after the other.
FILES_A_TASK = 8


class Rooms:
    """A segment tree over room sizes that tells which ranges have sequences; finds the least room of at least n."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, sequence: int) -> None:
        self.stacks[room].append(sequence)
        i = room + self.leaves
        while i and not self.some[i]:
            self.some[i] = True
            i >>= 1

    def pop(self, n: int) -> tuple[int, int] | None:
        """Takes out a sequence with the least room >= n."""
        i = n + self.leaves
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.leaves
        sequence = self.stacks[room].pop()
        if not self.stacks[room]:
            self.some[i] = False
            while i > 1 and not self.some[i ^ 1]:
                i >>= 1
                self.some[i] = False
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences."""
    rooms, n = Rooms(capacity), 0
    sequence, offset, sizes = [0] * len(lengths), [0] * len(lengths), lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        room, s = rooms.pop(size) or (capacity, n)
        n += s == n
        sequence[i], offset[i] = s, capacity - room
        if room > size:
            rooms.push(room - size, s)
    return np.array(sequence, np.int64), np.array(offset, np.int64), n


def filesystem(path: str):
    """The file system of a path that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else "file://" + os.path.abspath(path))


def write_whole(path: str, data: bytes, attempt: str) -> None:
    """The file appears whole or not at all, however often tasks are tried."""
    store, at = filesystem(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(f"{at}.{attempt}.tmp") as f:
        f.write(data)
    store.move(f"{at}.{attempt}.tmp", at)


def write_packed(docs: DataFrame, out: str, tokenizer: str = DEFAULT, capacity: int = 2048, end_id: int = 50256, batch_tokens: int = 2_000_000) -> DataFrame:
    """Write the files below ``out``; returns their manifest: path, sequences, pieces, tokens."""
    small_batches(docs.sparkSession)
    kind = np.uint16 if max(end_id, library(tokenizer).get_vocab_size() - 1) < 1 << 16 else np.uint32
    schema = pa.schema([("path", pa.string()), ("sequences", pa.int64()), ("pieces", pa.int64()), ("tokens", pa.int64())])

    def work(batches):
        from pyspark import TaskContext

        task, encoder, held, size, k = TaskContext.get(), worker_encoder(tokenizer), [], 0, 0
        end = np.array(end_id, "<u4").tobytes()

        def flush():
            data, n = packed(held, capacity, kind)
            path = f"{out}/part-{task.partitionId():05d}-{k:05d}.npz"
            write_whole(path, data, str(task.taskAttemptId()))
            return to_batch(schema, {"path": [path], "sequences": [n], "pieces": [len(held)], "tokens": [size]})

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(encoder.of(text) + end, "<u4").astype(kind)
                for p, s in enumerate(range(0, len(ids), capacity)):
                    held.append((i, p, s, ids[s : s + capacity]))
                size += len(ids)
                if size >= batch_tokens:
                    yield flush()
                    held, size, k = [], 0, k + 1
        if held:
            yield flush()

    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "path string, sequences long, pieces long, tokens long"), "manifest")


def packed(held: list, capacity: int, kind) -> tuple[bytes, int]:
    lengths = np.array([len(x[3]) for x in held], np.int64)
    sequence, offset, n = best_fit_decreasing(lengths, capacity)
    ids, resets = np.zeros((n, capacity), kind), np.zeros((n, capacity), bool)
    flat = ids.reshape(-1)
    for x, at in zip(held, (sequence * capacity + offset).tolist()):
        flat[at : at + len(x[3])] = x[3]
    resets[sequence, offset] = True
    order = np.lexsort((offset, sequence))
    ends = (offset + lengths)[order]
    each = np.bincount(sequence, minlength=n)
    row = np.concatenate([[0], np.cumsum(each + 1)])
    cumulative = np.zeros(row[-1], np.int32)  # for each sequence 0, then the end of each segment
    cumulative[np.arange(len(ends)) + sequence[order] + 1] = ends
    doc = np.array([-1 if held[i][0] is None else held[i][0] for i in order], np.int64)
    table = {"doc_id": doc, "no_id": np.array([held[i][0] is None for i in order]), "piece": np.array([held[i][1] for i in order], np.int32), "start": np.array([held[i][2] for i in order], np.int64)}
    buffer = io.BytesIO()
    np.savez(buffer, ids=ids, resets=np.packbits(resets, axis=1), cumulative_lengths=cumulative, sequence_rows=row, **table)
    return buffer.getvalue(), n


ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, file string, sequence long, offset long"


def read_packed(manifest: DataFrame) -> DataFrame:
    """Every piece as the files hold it; raises if a file's parts disagree."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("sequence", pa.int64()), ("offset", pa.int64())])

    def work(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = filesystem(path)
                with store.open_input_file(at) as f:
                    x = np.load(io.BytesIO(f.read()))
                ids, row, cumulative = x["ids"], x["sequence_rows"], x["cumulative_lengths"]
                sequence = np.repeat(np.arange(len(ids)), np.diff(row) - 1)
                first = np.arange(len(sequence)) + sequence
                offset, length = cumulative[first].astype(np.int64), np.diff(cumulative)[first].astype(np.int64)
                resets = np.unpackbits(x["resets"], axis=1, count=ids.shape[1]).astype(bool)
                if resets.sum() != len(offset) or not resets[sequence, offset].all():
                    raise ValueError(f"{path}: position resets and cumulative lengths disagree")
                flat = memoryview(ids.astype("<u4").reshape(-1).view(np.uint8))
                crc = [zlib.crc32(flat[4 * a : 4 * (a + n)]) for a, n in zip((sequence * ids.shape[1] + offset).tolist(), length.tolist())]
                yield to_batch(schema, {"doc_id": pa.array(x["doc_id"], mask=x["no_id"]), "piece": x["piece"], "start": x["start"], "length": length, "ids_crc32": crc, "file": [path.rsplit("/", 1)[1]] * len(crc), "sequence": sequence, "offset": offset})

    files = manifest.select("path")
    return files.repartition(reading_parts(files.sparkSession, manifest.count(), FILES_A_TASK), "path").mapInArrow(work, ROWS)


def pack_to_files(docs: DataFrame, out: str | None = None, **options) -> DataFrame:
    return read_packed(write_packed(docs, out or scratch(docs.sparkSession, "packed"), **options))
