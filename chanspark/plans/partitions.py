"""Row ranges of a table, and the bytes that each needs: every partition reads its own part of the file and no more."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO

import numpy as np

from ..sources.model import PIECE, Segment, Table

#: Bytes of records that a partition should have.
PARTITION_BYTES = 32 << 20


@dataclass
class RowRange:
    """Rows start to stop of a table; first is the number that the first of them gets."""

    path: str
    version: int
    table: Table
    channels: list[str]
    start: int
    stop: int
    first: int


def piece(stored: bytes, adler: int) -> bytes:
    """A piece of a compressed block, which may end without the mark of an end."""
    data = zlib.decompressobj(-15).decompress(stored)
    if zlib.adler32(data) != adler:
        raise ValueError("a piece of a compressed block has another Adler sum")
    return data


class Stream:
    """A chain of segments as one stream of bytes; compressed segments are opened when touched, one at a time."""

    def __init__(self, f: BinaryIO, segments: list[Segment], base: int = 0):
        self.f, self.segments = f, segments
        self.starts = [base]
        for s in segments:
            self.starts.append(self.starts[-1] + s.size)
        self.size = self.starts[-1]
        self.opened: tuple[int, bytes] = (-1, b"")

    def segment(self, k: int) -> bytes:
        if self.opened[0] != k:
            s = self.segments[k]
            self.f.seek(s.offset)
            data = piece(self.f.read(s.stored), s.param) if s.zip == PIECE else zlib.decompress(self.f.read(s.stored))  # both check the Adler sum
            if len(data) != s.size:
                raise ValueError(f"a compressed block of {s.size} bytes has {len(data)}")
            if s.zip == 1 and s.param:
                m = s.size // s.param
                whole = m * s.param
                data = np.frombuffer(data, np.uint8, whole).reshape(s.param, m).T.tobytes() + data[whole:]
            self.opened = (k, data)
        return self.opened[1]

    def read(self, a: int, b: int) -> bytes:
        if b > self.size:
            raise ValueError(f"the data end at byte {self.size}, before {b}")
        parts, k = [], bisect_right(self.starts, a) - 1
        while a < b:
            s, start = self.segments[k], self.starts[k]
            end = min(b, start + s.size)
            if s.zip is None:
                self.f.seek(s.offset + a - start)
                part = self.f.read(end - a)
                if len(part) < end - a:
                    raise ValueError("the file ends inside its data")
            else:
                part = self.segment(k)[a - start : end - start]
            parts.append(part)
            a, k = end, k + 1
        return parts[0] if len(parts) == 1 else b"".join(parts)


class Cutter:
    """Parts of a chain of segments by bytes; the chain is added up once."""

    def __init__(self, segments: list[Segment]):
        self.segments = segments
        self.starts = [0]
        for s in segments:
            self.starts.append(self.starts[-1] + s.size)

    def part(self, a: int, b: int) -> tuple[list[Segment], int]:
        """The segments that hold bytes a to b, and where the first of them starts."""
        if a >= b or not self.segments:
            return [], 0
        first, last = max(0, bisect_right(self.starts, a) - 1), bisect_left(self.starts, b)
        return self.segments[first:last], self.starts[min(first, len(self.starts) - 1)]


def row_ranges(path: str, version: int, table: Table, channels: list[str], first: int, target: int = PARTITION_BYTES, low: int = 0, high: int | None = None) -> Iterator[RowRange]:
    """Rows low to high of a table cut into row ranges; unsorted data, which has no fixed places, is one range.

    A range carries only the channels it decodes and the segments its rows are in, so all ranges together are no larger than
    the file's metadata, however many there are. Values of variable length may be anywhere in their own stream, which stays whole.
    """
    used = [g for g in table.groups if any(c.name in channels for c in g.channels)] or table.groups[:1]
    width = sum(max(1, g.record_size) for g in used)
    rows = table.rows
    fixed = all(g.sorted for g in used)
    if not fixed:
        if rows:
            yield RowRange(path, version, table, channels, 0, rows, first)
        return
    step = max(1, target // max(1, width))
    lean = [replace(g, channels=[c for c in g.channels if c.name in channels]) for g in used]
    cutters = [(Cutter(g.stream), Cutter(g.invalid)) for g in lean]
    for start in range(low, rows if high is None else min(rows, high), step):
        stop = min(rows if high is None else min(rows, high), start + step)
        groups = []
        for g, (stream, invalid) in zip(lean, cutters, strict=True):
            (own, base), (marks, marks_base) = stream.part(start * g.record_size, stop * g.record_size), invalid.part(start * g.inval_bytes, stop * g.inval_bytes)
            groups.append(replace(g, stream=own, stream_base=base, invalid=marks, invalid_base=marks_base))
        yield RowRange(path, version, replace(table, groups=groups), channels, start, stop, first + start)
