"""One file by many tasks.

Each partition of a table goes to a part beside the file, as finished bytes or as Arrow batches. Once the parts' sizes are
known, so is every byte's place: tasks then put their own stretches there, in the same file, in order of the partitions. The
driver sees sizes and places only. A task that runs again writes the same bytes to the same place.
"""

from __future__ import annotations

import os
import pickle
import shutil
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import accumulate
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .blocks4 import RESTARTS
from .writer import Writer

#: Bytes of a stream that a task puts in place, and those that it holds at once.
RANGE_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
#: Bytes of data between two places where decompression of a large block can begin.
PIECE_BYTES = 1 << 20


@dataclass
class Part:
    """What the task of a partition has left, and what it says of it."""

    path: str
    size: int
    said: Any


@contextmanager
def folder(to: str) -> Iterator[str]:
    """A new folder beside a file, for its parts."""
    path = f"{to}.{uuid.uuid4().hex}.parts"
    os.makedirs(path)
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)


def spooled(df: DataFrame, into: str, make: Callable[[Iterator[pa.RecordBatch], BinaryIO], Any]) -> list[Part]:
    """A part for each partition that has rows, in their order. The columns of the batches are named by number."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        full = (b for b in batches if b.num_rows)
        first = next(full, None)
        if first is None:
            return

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from full

        context = TaskContext.get()
        path = f"{into}/{context.partitionId()}-{context.taskAttemptId()}"
        with open(path, "wb") as f:
            said = make(again(), f)
        columns = [pa.array([context.partitionId()], pa.int64()), pa.array([path], pa.string()), pa.array([os.path.getsize(path)], pa.int64()), pa.array([pickle.dumps(said)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "path", "size", "said"])

    found = df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, "k long, path string, size long, said binary").collect()
    return [Part(r["path"], r["size"], pickle.loads(bytes(r["said"]))) for r in sorted(found, key=lambda r: r["k"])]


def everywhere(spark: SparkSession, tasks: list, work: Callable[[Any], Any]) -> list:
    """What work says of each item, in order; each is a task."""
    return spark.sparkContext.parallelize(tasks, len(tasks)).map(work).collect() if tasks else []


def arrow(batches: Iterator[pa.RecordBatch], f: BinaryIO, note: Callable[[pa.RecordBatch], None]) -> None:
    """Batches into a part, each shown to note."""
    sink = None
    for b in batches:
        note(b)
        sink = sink or pa.ipc.new_stream(f, b.schema)
        sink.write_batch(b)
    if sink:
        sink.close()


def batches(path: str) -> Iterator[pa.RecordBatch]:
    with open(path, "rb") as f, pa.ipc.open_stream(f) as r:
        yield from r


Slice = tuple[str, int, int]


class Parts:
    """Parts as one stream of bytes."""

    def __init__(self, parts: list[tuple[str, int]]):
        self.parts = parts
        self.starts = [0, *accumulate(size for _, size in parts)]
        self.size = self.starts[-1]

    def slices(self, a: int, b: int) -> list[Slice]:
        """(file, from, to) of each stretch of bytes a to b."""
        out, k = [], bisect_right(self.starts, a) - 1
        while a < b:
            end = min(b, self.starts[k + 1])
            if end > a:
                out.append((self.parts[k][0], a - self.starts[k], end - self.starts[k]))
            a, k = end, k + 1
        return out

    def ranges(self, step: int) -> list[tuple[int, int, list[Slice]]]:
        return [(a, b := min(self.size, a + step), self.slices(a, b)) for a in range(0, self.size, step)]


def bites(slices: list[Slice], size: int) -> Iterator[bytes]:
    """The bytes of slices, so many at a time."""
    held = bytearray()
    for path, a, b in slices:
        with open(path, "rb") as f:
            f.seek(a)
            while a < b:
                data = f.read(min(b - a, size - len(held)))
                if not data:
                    raise ValueError(f"{path} ends before byte {b}")
                held += data
                a += len(data)
                if len(held) == size:
                    yield bytes(held)
                    held = bytearray()
    if held:
        yield bytes(held)


def put(target: str, at: int, slices: list[Slice]) -> None:
    with open(target, "r+b") as f:
        f.seek(at)
        for data in bites(slices, CHUNK_BYTES):
            f.write(data)


def copied(spark: SparkSession, target: str, at: int, parts: list[tuple[str, int]]) -> None:
    """Parts one behind the other from a place of the file on."""
    everywhere(spark, [(at + a, s) for a, _, s in Parts(parts).ranges(RANGE_BYTES)], lambda t: put(target, *t))


def laid(spark: SparkSession, target: str, at: int, parts: list[tuple[str, int]], into: str, kind: bytes = b"DT", bite: int | None = None, compression: str | None = None, record: int = 1) -> tuple[list[tuple[int, int]], int]:
    """The parts' bytes as data blocks of so many bytes each (None: as one), from a place that 8 divides. Returns the place
    and the number of data bytes of each block, and the end. A block that compression would not make smaller stays plain."""
    whole = Parts(parts)
    if not whole.size:
        return [], at
    if compression and bite:
        return packed(spark, target, at, whole, into, kind, bite, compression, record)
    if compression and (end := one_packed(spark, target, at, whole, into, kind)):
        return [(at, whole.size)], end
    bite = bite or whole.size
    stride = 24 + bite + -bite % 8

    def work(task: tuple[int, int, list[Slice]]) -> None:
        a, _, slices = task
        with open(target, "r+b") as f:
            for data in bites(slices, CHUNK_BYTES):
                k = 0
                while k < len(data):
                    block, inside = divmod(a, bite)
                    size = min(bite, whole_size - block * bite)
                    part = data[k : k + size - inside]
                    f.seek(at + block * stride + (24 + inside if inside else 0))
                    f.write(part if inside else struct.pack("<4s4xQQ", b"##" + kind, 24 + size, 0) + part)
                    a, k = a + len(part), k + len(part)

    whole_size = whole.size
    everywhere(spark, whole.ranges(RANGE_BYTES), work)
    blocks = [(at + k * stride, min(bite, whole.size - k * bite)) for k in range(-(-whole.size // bite))]
    return blocks, blocks[-1][0] + 24 + blocks[-1][1] + -blocks[-1][1] % 8


def packed(spark: SparkSession, target: str, at: int, whole: Parts, into: str, kind: bytes, bite: int, compression: str, record: int) -> tuple[list[tuple[int, int]], int]:
    """Compressed blocks of so many bytes each. Their sizes show when they are made, so they are put in place after that."""

    def work(task: tuple[int, int, list[Slice]]) -> tuple[str, int, list[tuple[int, int]]]:
        path = f"{into}/{uuid.uuid4().hex}"
        with open(path, "wb") as f:
            w = Writer(f, "rows", compression, part=True)
            blocks = [(w.data(kind, data, record), len(data)) for data in bites(task[2], bite)]
        return path, w.at, blocks

    made = everywhere(spark, whole.ranges(max(1, RANGE_BYTES // bite) * bite), work)
    out, end = [], at
    for _, size, blocks in made:
        out += [(end + x, n) for x, n in blocks]
        end += size
    copied(spark, target, at, [(path, size) for path, size, _ in made])
    return out, end


def one_packed(spark: SparkSession, target: str, at: int, whole: Parts, into: str, kind: bytes) -> int | None:
    """One compressed block, however large. It is one zlib stream, made of pieces that refer to nothing before them; behind
    the stream, inside the block, stands where they begin, so that readers who know that may begin at any of them (the
    others read the stream). Returns the block's end, None if it would not be smaller."""
    size = whole.size

    def work(task: tuple[int, int, list[Slice]]) -> tuple[str, int, list[tuple[int, int, int]]]:
        a, path, pieces = task[0], f"{into}/{uuid.uuid4().hex}", []
        with open(path, "wb") as f:
            for data in bites(task[2], PIECE_BYTES):
                a += len(data)
                z = zlib.compressobj(6, zlib.DEFLATED, -15)
                out = z.compress(data) + z.flush(zlib.Z_FINISH if a == size else zlib.Z_FULL_FLUSH)
                f.write(out)
                pieces.append((len(data), len(out), zlib.adler32(data)))
        return path, os.path.getsize(path), pieces

    made = everywhere(spark, whole.ranges(RANGE_BYTES), work)
    pieces, adler = [p for _, _, some in made for p in some], 1
    for n, _, own in pieces:
        adler = joined_adler(adler, own, n)
    stored = 2 + sum(n for _, n, _ in pieces) + 4
    index = RESTARTS + struct.pack("<Q", len(pieces)) + b"".join(struct.pack("<3I", *p) for p in pieces)
    if stored + len(index) + 24 >= size:
        return None
    copied(spark, target, at + 50, [(path, n) for path, n, _ in made])
    with open(target, "r+b") as f:
        f.seek(at)
        f.write(struct.pack("<4s4xQQ2sBxIQQ", b"##DZ", 48 + stored + len(index), 0, kind, 0, 0, size, stored) + b"\x78\x9c")
        f.seek(at + 48 + stored - 4)
        f.write(struct.pack(">I", adler) + index)
    end = at + 48 + stored + len(index)
    return end + -end % 8


def joined_adler(a: int, b: int, n: int) -> int:
    """The Adler sum of two stretches from their own ones; n: bytes of the second."""
    base = 65521
    low = (a & 0xFFFF) + (b & 0xFFFF) - 1
    return (((a >> 16) + (b >> 16) + n * ((a & 0xFFFF) - 1)) % base) << 16 | low % base
