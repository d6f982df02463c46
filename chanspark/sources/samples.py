"""Files in layouts that measuring devices write and the writer does not: unsorted data, values in SD blocks or in groups
of their own, virtual channels, nested parts, and version 3. Used by the registered queries and the tests.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import parts
from .model import Conversion
from .writer import Writer, block


@dataclass
class Field:
    """A channel of a hand-made file."""

    name: str
    data_type: int
    bits: int
    byte: int = 0
    bit: int = 0
    kind: int = 0
    sync: int = 0
    flags: int = 0
    inval_bit: int = 0
    unit: str = ""
    description: str = ""
    conversion: Conversion | None = None
    data: int = 0
    shape: tuple[int, ...] = ()
    column_major: bool = False
    axes: tuple[tuple[float, ...], ...] = ()
    source: tuple[str, str] | None = None
    members: list[Field] = field(default_factory=list)


class Builder(Writer):
    """Blocks one by one."""

    def conversion(self, c: Conversion | str | None) -> int:
        if c is None or isinstance(c, str):
            return self.text(c or "") if c is None or c else self.put(block(b"TX", (), b"\0"))
        refs = [self.conversion(c.formula)] if c.kind == 3 else [self.conversion(r) for r in c.refs]
        values = struct.pack(f"<{len(c.values)}{'Q' if c.kind == 11 else 'd'}", *c.values)
        return self.put(block(b"CC", [self.text(c.name), self.text(c.unit), 0, 0, *refs], struct.pack("<BBHHHdd", c.kind, 0, 0, len(refs), len(c.values), 0, 0) + values))

    def fields(self, fields: list[Field]) -> int:
        following = 0
        for c in reversed(fields):
            composition = self.fields(c.members) if c.members else 0
            if c.shape:
                composition = self.put(block(b"CA", [0], struct.pack("<BBHIiI", 0, 0, len(c.shape), (64 if c.column_major else 0) | (32 if c.axes else 0), c.bits // 8, 0) + struct.pack(f"<{len(c.shape)}Q", *c.shape) + b"".join(struct.pack(f"<{len(a)}d", *a) for a in c.axes)))
            source = self.put(block(b"SI", [self.text(c.source[0]), self.text(c.source[1]), 0], struct.pack("<BBB5x", 1, 0, 0))) if c.source else 0
            links = [following, composition, self.text(c.name), source, self.conversion(c.conversion), c.data, self.text(c.unit), self.text(c.description)]
            following = self.put(block(b"CN", links, struct.pack("<4BIIIIBxHdddddd", c.kind, c.sync, c.data_type, c.bit, c.byte, c.bits, c.flags, c.inval_bit, 0, 0, *[0.0] * 6)))
        return following

    def group(self, fields: list[Field], rows: int, size: int, inval: int = 0, record_id: int = 0, flags: int = 0, following: int = 0, name: str = "", extra: tuple[int, ...] = ()) -> int:
        return self.put(block(b"CG", [following, self.fields(fields), self.text(name), 0, 0, 0, *extra], struct.pack("<QQHH4xII", record_id, rows, flags, 0, size, inval)))

    def data_group(self, group: int, data: int, id_size: int = 0, following: int = 0) -> int:
        return self.put(block(b"DG", [following, group, data, 0], struct.pack("<B7x", id_size)))

    def listed(self, blocks: list[tuple[int, int]], header: bool = False) -> int:
        offsets = np.cumsum([0, *(n for _, n in blocks)])[:-1]
        dl = self.put(block(b"DL", [0, *(at for at, _ in blocks)], struct.pack("<B3xI", 0, len(blocks)) + np.asarray(offsets, "<u8").tobytes()))
        return self.put(block(b"HL", [dl], struct.pack("<HB5x", 0, 0))) if header else dl


def build(df: DataFrame, path: str, make: Callable[[Iterator[pa.RecordBatch], str], None]) -> None:
    """Has one task write a file from df's batches: for tables whose rows do not grow."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make(batches, path)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    df.coalesce(1).mapInArrow(run, "done long").collect()


def begun(path: str) -> int:
    """A new file without content, and where its data may begin."""
    with open(path, "w+b") as f:
        return Builder(f).at


def ended(path: str, at: int, finish: Callable[[Builder], None]) -> None:
    """Has finish write a file's metadata behind its data."""
    with open(path, "r+b") as f:
        w = Builder(f, part=True)
        f.seek(at)
        w.at = at
        finish(w)


def packed(batch: pa.RecordBatch, kinds: list[str]) -> np.ndarray:
    """Bytes of numeric columns side by side."""
    cells = [np.ascontiguousarray(batch.column(k).to_numpy(zero_copy_only=False).astype(kind)).view(np.uint8).reshape(batch.num_rows, -1) for k, kind in enumerate(kinds)]
    return np.concatenate(cells, axis=1)


def packs(batches: Iterator[pa.RecordBatch], f: BinaryIO, kinds: list[str]) -> None:
    for batch in batches:
        f.write(packed(batch, kinds).tobytes())


def record_size(kinds: list[str]) -> int:
    return sum(np.dtype(k).itemsize for k in kinds)


def straddling(df: DataFrame, path: str, kinds: list[str], fields: list[Field], header: bool = False, compression: str | None = None, bite: int = 100_003, listed: bool = True) -> None:
    """A sorted group whose blocks end anywhere, in the middle of records too; without listed, one block."""
    size = record_size(kinds)
    with parts.folder(path) as into:
        stream = [(p.path, p.size) for p in parts.spooled(df, into, lambda batches, f: packs(batches, f, kinds))]
        blocks, end = parts.laid(df.sparkSession, path, begun(path), stream, into, b"DT", bite if listed else None, compression, size)
    rows = sum(n for _, n in stream) // size

    def finish(w: Builder) -> None:
        data = 0 if not blocks else blocks[0][0] if len(blocks) == 1 and not header else w.listed(blocks, header)
        w.seal(w.data_group(w.group(fields, rows, size), data))

    ended(path, end, finish)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and their lengths."""
    if column.null_count:
        raise ValueError("values of variable length are not null here")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, np.diff(ends)


def scattered(heads: np.ndarray, tails: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row by row: a head of fixed bytes, so many of data, a tail of fixed bytes."""
    head, tail = heads.shape[1], tails.shape[1]
    before = np.cumsum(sizes) - sizes
    starts = before + np.arange(len(sizes)) * (head + tail)
    out = np.empty(int(sizes.sum()) + len(sizes) * (head + tail), np.uint8)
    out[starts[:, None] + np.arange(head)] = heads
    out[np.arange(len(data)) + np.repeat(starts + head - before, sizes)] = data
    out[(starts + head + sizes)[:, None] + np.arange(tail)] = tails
    return out


def columns_of(*columns: tuple[np.ndarray | int, str], rows: int) -> np.ndarray:
    """Numbers side by side as bytes (rows, width)."""
    return np.concatenate([np.broadcast_to(np.asarray(x).astype(kind), (rows,)).copy().view(np.uint8).reshape(rows, -1) for x, kind in columns], axis=1)


def variable_bytes(batch: pa.RecordBatch, place: int, in_group: bool) -> tuple[bytes, bytes, int]:
    """Records and values of a batch (key, value), the first of which has this place; and the place behind the last."""
    n, key = batch.num_rows, batch.column(0).to_numpy(zero_copy_only=False)
    data, sizes = texts(batch.column(1))
    places = place + np.cumsum(sizes + 4) - (sizes + 4)
    behind = place + int((sizes + 4).sum())
    none = np.zeros((n, 0), np.uint8)
    if in_group:
        return scattered(columns_of((2, "<u1"), (sizes, "<u4"), rows=n), columns_of((1, "<u1"), (key, "<i8"), (places, "<u8"), rows=n), data, sizes).tobytes(), b"", behind
    return columns_of((key, "<i8"), (places, "<u8"), rows=n).tobytes(), scattered(columns_of((sizes, "<u4"), rows=n), none, data, sizes).tobytes(), behind


def variable_end(w: Builder, rows: int, data: int, sd: int, in_group: bool) -> None:
    if in_group:
        own = w.group([], rows, 0, record_id=2, flags=1)
        fixed = w.group([Field("key", 2, 64, 0), Field("value", 7, 64, 8, kind=1, data=own)], rows, 16, record_id=1, following=own)
        w.seal(w.data_group(fixed, data, 1))
    else:
        w.seal(w.data_group(w.group([Field("key", 2, 64, 0), Field("value", 7, 64, 8, kind=1, data=sd)], rows, 16), data))


def variable(batches: Iterator[pa.RecordBatch], path: str, in_group: bool) -> None:
    """Columns (key long, value string): values in an SD block, or in a channel group of their own in unsorted data."""
    with open(path, "w+b") as f:
        w, place, rows, made = Builder(f, "rows"), 0, 0, []
        for batch in batches:
            records, values, place = variable_bytes(batch, place, in_group)
            made.append((records, values))
            rows += batch.num_rows
        data = w.data(b"DT", b"".join(r for r, _ in made), 1)
        variable_end(w, rows, data, 0 if in_group else w.data(b"SD", b"".join(v for _, v in made), 1), in_group)


def variables(df: DataFrame, path: str, in_group: bool) -> None:
    """The same file by a task for each partition: where a partition's values begin is known once all have been measured."""
    spark, at = df.sparkSession, begun(path)

    def measure(batches: Iterator[pa.RecordBatch], f: BinaryIO) -> list[int]:
        said = [0, 0]

        def note(b: pa.RecordBatch) -> None:
            said[0] += b.num_rows
            said[1] += 4 * b.num_rows + int(texts(b.column(1))[1].sum())

        parts.arrow(batches, f, note)
        return said

    with parts.folder(path) as into:
        made = parts.spooled(df, into, measure)
        rows, size = (sum(p.said[k] for p in made) for k in range(2))
        n = 18 * rows + size if in_group else 16 * rows
        sd = at + 24 + n + -n % 8
        tasks, row, place = [], 0, 0
        for p in made:
            tasks.append((p.path, at + 24 + (18 * row + place if in_group else 16 * row), sd + 24 + place, place))
            row, place = row + p.said[0], place + p.said[1]

        def work(task: tuple[str, int, int, int]) -> None:
            source, to, to_values, place = task
            with open(path, "r+b") as f:
                for batch in parts.batches(source):
                    records, values, place = variable_bytes(batch, place, in_group)
                    for where, data in ((to, records), (to_values, values)):
                        f.seek(where)
                        f.write(data)
                    to, to_values = to + len(records), to_values + len(values)

        parts.everywhere(spark, tasks, work)
    with open(path, "r+b") as f:
        for where, kind, bytes_ in ((at, b"DT", n), *([] if in_group else [(sd, b"SD", size)])):
            f.seek(where)
            f.write(struct.pack("<4s4xQQ", b"##" + kind, 24 + bytes_, 0))
    end = sd if in_group else sd + 24 + size + -size % 8
    ended(path, end, lambda w: variable_end(w, rows, at, sd, in_group))


def mixed_bytes(batch: pa.RecordBatch, id_size: int) -> tuple[bytes, int]:
    """Records of a batch (tag int, key long, value double), and how many of them are of the second group."""
    tag, key, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    second, n = tag == 1, batch.num_rows
    head = columns_of((tag + 1, "<u8"), rows=n)[:, :id_size]
    rest = columns_of((key % 7, "<i4"), rows=n)[second].ravel()
    body = np.concatenate([head, columns_of((key, "<i8"), (value, "<f8"), rows=n)], axis=1)
    return scattered(body, np.zeros((n, 0), np.uint8), rest, np.where(second, 4, 0)).tobytes(), int(second.sum())


def mixed_end(w: Builder, n: list[int], blocks: list[tuple[int, int]], id_size: int) -> None:
    second = w.group([Field("key_b", 2, 64, 0), Field("value_b", 4, 64, 8), Field("rest_b", 2, 32, 16)], n[1], 20, record_id=2)
    first = w.group([Field("key_a", 2, 64, 0), Field("value_a", 4, 64, 8)], n[0], 16, record_id=1, following=second)
    w.seal(w.data_group(first, w.listed(blocks) if blocks else 0, id_size))


#: Bytes of a block of mixed records, which ends anywhere in them.
MIXED_BITE = 70_001


def mixed(batches: Iterator[pa.RecordBatch], path: str, id_size: int = 2, compression: str | None = None) -> None:
    """Columns (tag int, key long, value double): two groups, records in turn; the second group's hold a number more."""
    with open(path, "w+b") as f:
        w, blocks, rest, n = Builder(f, "rows", compression), [], b"", [0, 0]
        for batch in batches:
            data, second = mixed_bytes(batch, id_size)
            n = [n[0] + batch.num_rows - second, n[1] + second]
            rest += data
            while len(rest) > MIXED_BITE:
                blocks.append((w.data(b"DT", rest[:MIXED_BITE], 1), MIXED_BITE))
                rest = rest[MIXED_BITE:]
        blocks.append((w.data(b"DT", rest, 1), len(rest)))
        mixed_end(w, n, blocks, id_size)


def mixture(df: DataFrame, path: str, id_size: int = 2, compression: str | None = None) -> None:
    """The same file by a task for each partition."""

    def pack(batches: Iterator[pa.RecordBatch], f: BinaryIO) -> list[int]:
        n = [0, 0]
        for batch in batches:
            data, second = mixed_bytes(batch, id_size)
            n = [n[0] + batch.num_rows - second, n[1] + second]
            f.write(data)
        return n

    with parts.folder(path) as into:
        made = parts.spooled(df, into, pack)
        blocks, end = parts.laid(df.sparkSession, path, begun(path), [(p.path, p.size) for p in made], into, b"DT", MIXED_BITE, compression)
    ended(path, end, lambda w: mixed_end(w, [sum(p.said[k] for p in made) for k in range(2)], blocks, id_size))


def documented(path: str, attachments: Iterable[tuple[str, bytes, bool]], events: Iterable[tuple[str, int, int, float]], comments: dict[str, str], start_ns: int) -> None:
    """A file without data: attachments (name, bytes, whether compressed), events (name, type, base, factor), comments, history."""
    with open(path, "w+b") as f:
        w = Builder(f, comments=comments, start_ns=start_ns)
        first = [0, 0]
        for name, data, packed_ in reversed(list(attachments)):
            stored = zlib.compress(data) if packed_ else data
            first[0] = w.put(block(b"AT", [first[0], w.text(name), w.text("text/plain"), 0], struct.pack("<HH4x16sQQ", 7 if packed_ else 5, 0, hashlib.md5(data).digest(), len(data), len(stored)) + stored))
        for name, kind, base, factor in reversed(list(events)):
            first[1] = w.put(block(b"EV", [first[1], 0, 0, w.text(name), 0], struct.pack("<5B3xIHHqd", kind, 1, 0, 1, 0, 0, 0, 0, base, factor)))
        w.seal(0)
        f.seek(64 + 24 + 24)
        f.write(struct.pack("<qq", *first))


def version3(path: str, records: bytes | None, rows: int, size: int, channels: Iterable[dict], version: int = 330, big: bool = False, groups: list[dict] | None = None, n_ids: int = 0) -> int:
    """A file of version 3 with one group (or several: dicts with record_id, rows, size, channels). Returns where the records
    stand; None for those that others will put there, at the end. A channel is a dict:
    name, type, byte, bit, bits, and perhaps master, unit, description, cc (kind, number of entries, bytes), ce (kind, bytes)."""
    e = ">" if big else "<"
    out = bytearray(b"\0" * (64 + (208 if version >= 320 else 164)))

    def put(data: bytes) -> int:
        at = len(out)
        out.extend(data)
        return at

    def text(t: str) -> int:
        data = t.encode("cp1252") + b"\0"
        return put(b"TX" + struct.pack(e + "H", 4 + len(data)) + data) if t else 0

    data = put(records) if records is not None else None
    following_cg = 0
    for g in reversed(groups or [{"record_id": 0, "rows": rows, "size": size, "channels": channels}]):
        following = 0
        for c in reversed(list(g["channels"])):
            cc = ce = 0
            if "cc" in c:
                kind, n, body = c["cc"]
                if kind == 12:  # (low, high, text) rows
                    body = b"".join(struct.pack(e + "ddI", low, high, text(t)) for low, high, t in body)
                cc = put(b"CC" + struct.pack(e + "HHdd", 46 + len(body), 0, 0, 0) + c.get("unit", "").encode().ljust(20, b"\0") + struct.pack(e + "HH", kind, n) + body)
            if "ce" in c:
                kind, body = c["ce"]
                ce = put(b"CE" + struct.pack(e + "HH", 6 + len(body), kind) + body)
            long_name = text(c["name"]) if len(c["name"]) > 31 else 0
            first_bit = 8 * c.get("byte", 0) + c.get("bit", 0)
            following = put(b"CN" + struct.pack(e + "HIIIIIH", 228, following, cc, ce, 0, 0, int(c.get("master", False))) + c["name"][:31].encode("cp1252").ljust(32, b"\0") + c.get("description", "").encode("cp1252").ljust(128, b"\0") + struct.pack(e + "HHHHdddIIH", first_bit, c["bits"], c["type"], 0, 0, 0, 0, long_name, 0, 0))
        following_cg = put(b"CG" + struct.pack(e + "HIIIHHHI", 26, following_cg, following, 0, g["record_id"], 0, g["size"], g["rows"]))
    data = len(out) + 28 if data is None else data
    dg = put(b"DG" + struct.pack(e + "HIIIIHH4x", 28, 0, following_cg, 0, data, 1, n_ids))
    out[0:64] = struct.pack(e + "8s8s8s4H28x2H", b"MDF     ", f"{version / 100:.2f}    ".encode(), b"chanspk ", int(big), 0, version, 1252, 0, 0)
    head = b"HD" + struct.pack(e + "HIIIH", 208 if version >= 320 else 164, dg, 0, 0, 1) + b"01:02:2003" + b"04:05:06" + b"An Author".ljust(32, b"\0") + b"Org".ljust(32, b"\0") + b"Project".ljust(32, b"\0") + b"Subject".ljust(32, b"\0")
    if version >= 320:
        head += struct.pack(e + "QhH", 1_044_072_306 * 10**9, 0, 0) + b"clock".ljust(32, b"\0")
    out[64 : 64 + len(head)] = head
    with open(path, "wb") as f:
        f.write(out)
    return data


def version3_table(df: DataFrame, path: str, kinds: list[str], channels: list[dict]) -> None:
    """A file of version 3 with one group, by a task for each partition."""
    size = record_size(kinds)
    with parts.folder(path) as into:
        stream = [(p.path, p.size) for p in parts.spooled(df, into, lambda batches, f: packs(batches, f, kinds))]
        at = version3(path, None, sum(n for _, n in stream) // size, size, channels)
        parts.copied(df.sparkSession, path, at, stream)
