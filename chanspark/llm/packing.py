"""Sum-of-squares online packing of token sequences.

Each task packs its own documents in the order in which they come. Open windows are counted by fill level; a document
goes to the level (or to a new window) that leaves the smallest sum of squared counts of partially filled windows (Csirik
et al.). A document longer than a window first fills whole windows. Every document is placed by that rule, however many
windows are open. Since cutting is free, no padding has to remain: at the end of a task the documents of the windows
that are still open are laid end to end and cut into full windows, and what is left of them into sequences whose lengths
are powers of two, which need no padding.

A task holds the ids of its open windows. On mixed lengths these are a few hundred windows (some MB); lengths that never
fit together (all of 1500 ids, say) would leave all of them open. So when they take more than MAX_BYTES, two windows of
the level that has the most are laid end to end, with one cut at most, until they take less: of all ways to be rid of a
window, the one that lowers the sum of squares most. No document is placed otherwise for that. Sequence ids are unique
across tasks: the partition's number and a counter within it. Run over the same partitions, the result is the same.

A null or empty text is the closing id alone. Repeated rows are packed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokenizer import ByteEncoder, blocks, crc32, default_path, load

WINDOW = 2048
CLOSING_ID = 1
#: Ids that a task's open windows may hold, in bytes. Far above 2048 windows, so some level has two whenever it is passed.
MAX_BYTES = 64 << 20


class Packer:
    """Packs the documents of one partition; finished pieces are (id, start, length, crc, tokens, sequence, offset, ids)."""

    def __init__(self, partition: int, window: int = WINDOW, max_bytes: int = MAX_BYTES):
        self.next = partition << 40
        self.window, self.max_ids = window, max(max_bytes // 4, window * window)
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.held = 0  # ids in open windows
        self.done: list[tuple] = []

    def add(self, key: int | None, ids: bytes) -> None:
        """Places a document, given as 32-bit ids."""
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.close([(key, start, total, ids[4 * start : 4 * (start + self.window)])])
            start += self.window
        if start < total:
            self.place((key, start, total, ids[4 * start :]))

    def place(self, piece: tuple) -> None:
        size = len(piece[3]) // 4
        # A window of level h becomes one of level h + size: the sum of squares changes by 2 (n[h + size] - n[h] + 1);
        # a full window no longer counts, and a new one comes from nowhere.
        n = self.counts
        best, level = 2 * int(n[size]) + 1, 0
        usable = np.flatnonzero(n[1 : self.window - size + 1]) + 1
        if len(usable):
            change = 2 * (n[usable + size] - n[usable] + 1)
            if usable[-1] + size == self.window:
                change[-1] = 1 - 2 * n[usable[-1]]
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
            if change[k] <= best:
                level = int(usable[k])
        pieces = self.take(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            self.close(pieces)
            return
        self.put(level + size, pieces)
        while self.held > self.max_ids:
            self.join()

    def take(self, level: int) -> list:
        self.counts[level] -= 1
        self.held -= level
        return self.levels[level].pop()

    def put(self, level: int, pieces: list) -> None:
        self.counts[level] += 1
        self.held += level
        self.levels[level].append(pieces)

    def join(self) -> None:
        """Lays two windows of the fullest of the levels that have the most end to end."""
        level = self.window - int(np.argmax(self.counts[::-1]))
        rest = self.lay(self.take(level) + self.take(level))
        if rest:
            self.put(sum(len(p[3]) for p in rest) // 4, rest)

    def lay(self, pieces: list) -> list:
        """Closes full windows of these pieces, cut where they end; the pieces of the last, not full, are returned."""
        window: list[tuple] = []
        room = self.window
        for key, start, total, ids in pieces:
            while ids:
                head, ids = ids[: 4 * room], ids[4 * room :]
                window.append((key, start, total, head))
                start += len(head) // 4
                room -= len(head) // 4
                if not room:
                    self.close(window)
                    window, room = [], self.window
        return window

    def finish(self) -> None:
        """Closes all windows, without padding."""
        rest = self.lay([p for level in range(self.window, 0, -1) for _ in range(len(self.levels[level])) for p in self.take(level)])
        fill = sum(len(p[3]) for p in rest) // 4
        while fill:
            size = 1 << (fill.bit_length() - 1)
            fill -= size
            part, left = [], size
            while left:
                key, start, total, ids = rest.pop(0)
                part.append((key, start, total, ids[: 4 * left]))
                if len(ids) > 4 * left:
                    rest.insert(0, (key, start + left, total, ids[4 * left :]))
                left -= len(part[-1][3]) // 4
            self.close(part)

    def close(self, pieces: list) -> None:
        offset = 0
        for key, start, total, ids in pieces:
            size = len(ids) // 4
            self.done.append((key, start, size, crc32(ids), total, self.next, offset, ids))
            offset += size
        self.next += 1


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece. with_ids adds the ids themselves, as a binary column of little-endian 32-bit numbers."""
    path = path or default_path("byte_bpe_50k.json")
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * 8
        arrays = [pa.array(columns[k], pa.int64()) for k in range(7)]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(columns[7], pa.binary())] * with_ids, names=_NAMES + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = load(ByteEncoder, path), Packer(TaskContext.get().partitionId(), window)
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for block in blocks(batch.column(1).to_pylist()):
                for ids in encoder.encode(block):
                    packer.add(next(keys), ids + closing)
                done, packer.done = packer.done, []
                yield rows(done)
        packer.finish()
        yield rows(packer.done)

    schema = ", ".join(f"{n} long" for n in _NAMES) + ", ids binary" * with_ids
    packed = map_arrow(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t")), run, schema)
    return packed.withColumnRenamed("id", key)
