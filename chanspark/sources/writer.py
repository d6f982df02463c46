"""Writing MDF 4.2: data blocks are streamed as batches come, metadata follow at the end of the file.

Layouts: "columns" (a channel group for each channel, values column by column in DV blocks under an LD list, the master
borrowed by the others), "rows" (one group, DT blocks under a DL list), "row" (one DT block), each optionally with DZ
compression, by "deflate" or, for rows, "transpose". A block that compression would not make smaller stays plain.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.datasource import WriterCommitMessage

from .files import local

PROGRAM = b"chanspk "


def block(name: bytes, links: Iterable[int], body: bytes) -> bytes:
    links = list(links)
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<4s4xQQ", b"##" + name, 24 + 8 * len(links) + len(body), len(links)) + struct.pack(f"<{len(links)}q", *links) + body


@dataclass
class Column:
    """What is written for a column. data_type as in the file; width in bytes; inner shape for arrays."""

    name: str
    data_type: int
    width: int
    shape: tuple[int, ...] = ()
    unit: str = ""
    description: str = ""
    sync: int = 0
    conversion: tuple[int, list[float]] | None = None


class Writer:
    """A table of a file, from Arrow batches. after: the size of a finished file that gets one table more, else a new one is
    made. part: data blocks alone, with places from 0, for a file that is put together later."""

    def __init__(self, f: BinaryIO, layout: str = "columns", compression: str | None = None, start_ns: int = 0, comments: dict[str, str] | None = None, after: int | None = None, part: bool = False):
        if layout not in ("columns", "rows", "row") or compression not in (None, "deflate", "transpose"):
            raise ValueError(f"no such layout: {layout}, {compression}")
        self.f, self.layout, self.compression = f, layout, compression
        self.start_ns, self.comments = start_ns, comments or {}
        self.rows = 0
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        self.invalid: dict[int, list[int]] = {}
        self.columns: list[Column] = []
        self.after = after
        if part:
            self.at = 0
        elif after is None:
            self.at = 64 + 104
            f.write(b"\0" * self.at)  # identification and header are written last
        else:
            f.truncate(after)
            self.at = after + -after % 8
            f.seek(after)
            f.write(b"\0" * (self.at - after))

    def put(self, data: bytes) -> int:
        at, data = self.at, data + b"\0" * (-len(data) % 8)
        self.f.write(data)
        self.at += len(data)
        return at

    def text(self, value: str) -> int:
        return self.put(block(b"TX", (), value.encode() + b"\0")) if value else 0

    def data(self, kind: bytes, body: bytes, record: int) -> int:
        if self.compression:
            how, plain, param = 0, body, 0
            if self.compression == "transpose" and kind == b"DT":
                how, param = 1, record
                m = len(body) // record
                plain = np.frombuffer(body, np.uint8, m * record).reshape(m, record).T.tobytes() + body[m * record :]
            packed = zlib.compress(plain, 6)
            if len(packed) + 24 < len(body):
                return self.put(struct.pack("<4s4xQQ2sBxIQQ", b"##DZ", 48 + len(packed), 0, kind, how, param, len(body), len(packed)) + packed)
        return self.put(struct.pack("<4s4xQQ", b"##" + kind, 24 + len(body), 0) + body)

    def start(self, columns: list[Column]) -> None:
        self.columns = columns

    def write(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        if not n:
            return
        if self.layout == "columns":
            for k, c in enumerate(self.columns):
                cell, null = encode(batch.column(k), c), batch.column(k).is_null().to_numpy(zero_copy_only=False)
                self.blocks.setdefault(k, []).append((self.data(b"DV", cell.tobytes(), cell.shape[1]), n))
                self.invalid.setdefault(k, []).append(self.data(b"DI", null.astype(np.uint8).tobytes(), 1))
        else:
            record = self.records(batch)
            self.blocks.setdefault(0, []).append((self.data(b"DT", record.tobytes(), record.shape[1]), n * record.shape[1]))
        self.rows += n

    def records(self, batch: pa.RecordBatch) -> np.ndarray:
        """A batch's records (rows, bytes): its columns side by side, then the bits of nulls."""
        cells = [encode(batch.column(k), c) for k, c in enumerate(self.columns)]
        nulls = [batch.column(k).is_null().to_numpy(zero_copy_only=False) for k in range(len(self.columns))]
        return np.concatenate([*cells, np.packbits(np.stack(nulls, axis=1), axis=1, bitorder="little")], axis=1)

    def chain(self, k: int, record: int) -> int:
        """The link to a column's (or all columns') data."""
        parts = self.blocks.get(k, [])
        if not parts:
            return 0
        if self.layout == "columns":
            links = [x for (at, _), inv in zip(parts, self.invalid[k], strict=True) for x in (at, inv)]
            offsets = np.cumsum([0, *(n for _, n in parts)])[:-1]
            return self.put(block(b"LD", [0, *links], struct.pack("<II", 1 << 31, len(parts)) + np.asarray(offsets, "<u8").tobytes()))
        if len(parts) == 1:
            return parts[0][0]
        offsets = np.cumsum([0, *(n for _, n in parts)])[:-1]
        dl = self.put(block(b"DL", [0, *(at for at, _ in parts)], struct.pack("<B3xI", 0, len(parts)) + np.asarray(offsets, "<u8").tobytes()))
        return self.put(block(b"HL", [dl], struct.pack("<HB5x", 0, int(self.compression == "transpose")))) if self.compression else dl

    def channel(self, c: Column, following: int, byte: int, inval_bit: int, master: bool) -> int:
        composition = 0
        if c.shape:
            composition = self.put(block(b"CA", [0], struct.pack("<BBHIiI", 0, 0, len(c.shape), 0, c.width, 0) + struct.pack(f"<{len(c.shape)}Q", *c.shape)))
        cc = 0
        if c.conversion:
            kind, values = c.conversion
            cc = self.put(block(b"CC", [0, 0, 0, 0], struct.pack("<BBHHHdd", kind, 0, 0, 0, len(values), 0, 0) + struct.pack(f"<{len(values)}d", *values)))
        links = [following, composition, self.text(c.name), 0, cc, 0, self.text(c.unit), self.text(c.description)]
        body = struct.pack("<4BIIIIBxHdddddd", 2 if master else 0, c.sync if master else 0, c.data_type, 0, byte, 8 * c.width, 2, inval_bit, 0, 0, *[0.0] * 6)
        return self.put(block(b"CN", links, body))

    def finish(self) -> None:
        masters = [k for k, c in enumerate(self.columns) if c.sync]
        first = masters[0] if masters else None
        following = 0
        if self.layout == "columns":
            order = ([first] if first is not None else [0] if self.columns else []) + [k for k in range(len(self.columns)) if k != (first or 0)]
            home = 0
            made = []
            for k in order:  # the home group comes first, as the others point to it
                c = self.columns[k]
                cn = self.channel(c, 0, 0, 0, k == first)
                size = c.width * int(np.prod(c.shape, dtype=np.int64)) if c.shape else c.width
                links = [0, cn, 0, 0, 0, 0, *([home] if home else [])]
                cg = self.put(block(b"CG", links, struct.pack("<QQHH4xII", 0, self.rows, 8 if home else 0, 0, size, 1)))
                home = home or cg
                made.append((cg, self.chain(k, size)))
            for cg, data in reversed(made):
                following = self.put(block(b"DG", [following, cg, data, 0], struct.pack("<B7x", 0)))
        elif self.columns:
            byte, places = 0, []
            for c in self.columns:
                places.append(byte)
                byte += c.width * int(np.prod(c.shape, dtype=np.int64)) if c.shape else c.width
            cn = 0
            for k in range(len(self.columns) - 1, -1, -1):
                cn = self.channel(self.columns[k], cn, places[k], k, k == first)
            inval = (len(self.columns) + 7) // 8
            cg = self.put(block(b"CG", [0, cn, 0, 0, 0, 0], struct.pack("<QQHH4xII", 0, self.rows, 0, 0, byte, inval)))
            following = self.put(block(b"DG", [0, cg, self.chain(0, byte + inval), 0], struct.pack("<B7x", 0)))
        self.link(following) if self.after is not None else self.seal(following)

    def link(self, following: int) -> None:
        """Hangs data groups behind the file's last one. A link to behind the old end is left of an attempt that failed."""
        at = 64 + 24
        while True:
            self.f.seek(at)
            (there,) = struct.unpack("<Q", self.f.read(8))
            if not 0 < there < self.after:
                break
            at = there + 24
        self.f.flush()
        self.f.seek(at)
        self.f.write(struct.pack("<Q", following))

    def seal(self, following: int) -> None:
        """History, comments, and at last the identification and the header, which points to the first data group."""
        fh_md = self.put(block(b"MD", (), b"<FHcomment><TX>written</TX><tool_id>chanspark</tool_id></FHcomment>\0"))
        fh = self.put(block(b"FH", [0, fh_md], struct.pack("<QhhB3x", self.start_ns, 0, 0, 0)))
        md = 0
        if self.comments:
            from xml.sax.saxutils import escape, quoteattr

            pairs = "".join(f"<e name={quoteattr(k)}>{escape(v)}</e>" for k, v in self.comments.items() if k != "comment")
            md = self.put(block(b"MD", (), f"<HDcomment><TX>{escape(self.comments.get('comment', ''))}</TX><common_properties>{pairs}</common_properties></HDcomment>".encode() + b"\0"))
        self.f.seek(0)
        self.f.write(struct.pack("<8s8s8s4xHH30x2x", b"MDF     ", b"4.20    ", PROGRAM, 420, 0))
        self.f.seek(64)
        self.f.write(block(b"HD", [following, fh, 0, 0, 0, md], struct.pack("<QhhBBBxdd", self.start_ns, 0, 0, 0, 0, 0, 0.0, 0.0)))


_TYPES = {T.BooleanType: (2, 1), T.ByteType: (2, 1), T.ShortType: (2, 2), T.IntegerType: (2, 4), T.LongType: (2, 8), T.FloatType: (4, 4), T.DoubleType: (4, 8), T.TimestampType: (2, 8), T.TimestampNTZType: (2, 8), T.DateType: (2, 4)}


def column_of(f: T.StructField, width: int, shape: tuple[int, ...] = ()) -> Column:
    """How a Spark column is written. width: bytes of the longest value, for texts and bytes."""
    kind, m = f.dataType, f.metadata or {}
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if isinstance(kind, T.StringType):
        data_type, width = 7, max(1, width)
    elif isinstance(kind, T.BinaryType):
        data_type, width = 10, max(1, width)
    elif isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 20:
        data_type, width = 0, 8
    elif isinstance(kind, T.StructType) and [x.name for x in kind] == ["re", "im"]:
        data_type, width = 15, 2 * _TYPES[type(kind["re"].dataType)][1]
    elif type(kind) in _TYPES:
        data_type, width = _TYPES[type(kind)]
    else:
        raise TypeError(f"{f.name}: {kind.simpleString()} cannot be written as a channel")
    return Column(f.name, data_type, width, shape, m.get("unit", ""), m.get("description", ""), int(m.get("sync_type", 0)) if m.get("master") == f.name else 0)


def encode(array: pa.Array, c: Column) -> np.ndarray:
    """Bytes (rows, width) of a column; null as zeros."""
    n = len(array)
    if pa.types.is_list(array.type):
        size = int(np.prod(c.shape, dtype=np.int64))
        rows = [flat(x, size) for x in array.to_pylist()]
        kind = {(2, 1): "i1", (2, 2): "<i2", (2, 4): "<i4", (2, 8): "<i8", (4, 4): "<f4", (4, 8): "<f8"}[c.data_type, c.width]
        return np.array(rows, dtype=kind).reshape(n, size).view(np.uint8).reshape(n, size * c.width)
    if pa.types.is_struct(array.type):
        kind = f"<f{c.width // 2}"
        parts = [array.field(k).fill_null(0).to_numpy(zero_copy_only=False).astype(kind) for k in range(2)]
        return np.stack(parts, axis=1).view(np.uint8).reshape(n, c.width)
    if c.data_type in (7, 10):
        values = [(v.encode() if isinstance(v, str) else v or b"") for v in array.to_pylist()]
        return np.array(values, dtype=f"S{c.width}").view(np.uint8).reshape(n, c.width) if n else np.zeros((0, c.width), np.uint8)
    if pa.types.is_timestamp(array.type):
        array = array.cast(pa.timestamp("us", array.type.tz)).cast(pa.int64())
        array = pc.multiply(array, 1000)
    elif pa.types.is_date(array.type):
        array = array.cast(pa.int32())
    elif pa.types.is_boolean(array.type):
        array = array.cast(pa.int8())
    elif pa.types.is_decimal(array.type):
        array = array.cast(pa.uint64())
    kind = {0: "<u", 2: "<i", 4: "<f"}[c.data_type] + str(c.width)
    x = array.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
    return np.ascontiguousarray(x).view(np.uint8).reshape(n, c.width)


def flat(x: list | None, size: int) -> list:
    if x is None:
        return [0] * size
    while x and isinstance(x[0], list):
        x = [z for y in x for z in y]
    if len(x) != size:
        raise ValueError("the arrays of a channel must have one shape")
    return [0 if v is None else v for v in x]


@dataclass
class Spool:
    """Batches of a task on local disk until the widths of its texts are known."""

    path: str
    widths: dict[str, int] = field(default_factory=dict)
    shapes: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def note(self, batch: pa.RecordBatch) -> None:
        for k, name in enumerate(batch.schema.names):
            col = batch.column(k)
            if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
                self.widths[name] = max(self.widths.get(name, 1), pc.max(pc.binary_length(col)).as_py() or 1)
            elif pa.types.is_list(col.type) and name not in self.shapes and col.null_count < len(col):
                value, shape = next(x for x in col.to_pylist() if x is not None), []
                while isinstance(value, list):
                    shape.append(len(value))
                    value = value[0] if value else None
                self.shapes[name] = tuple(shape)


def write_file(path: str, batches: Iterator[pa.RecordBatch], schema: T.StructType, layout: str = "columns", compression: str | None = None, start_ns: int = 0, comments: dict[str, str] | None = None, after: int | None = None) -> int:
    """Writes one file, or one more table behind the first so many bytes of one, and returns its number of rows. Texts need
    their width in advance, so batches are spooled once."""
    spool = Spool(path + ".spool")
    kept, sink, first = [], None, None
    try:
        for batch in batches:
            first = first or batch.schema
            spool.note(batch)
            if sink is None and len(kept) < 8:
                kept.append(batch)
                continue
            if sink is None:
                sink = pa.ipc.new_file(spool.path, first)
            sink.write_batch(batch)
        if sink is not None:
            sink.close()
        columns = [column_of(f, spool.widths.get(f.name, 1), spool.shapes.get(f.name, (1,) if isinstance(f.dataType, T.ArrayType) else ())) for f in schema]
        with open(path, "w+b" if after is None else "r+b") as f:
            w = Writer(f, "rows" if layout == "row" else layout, compression, start_ns, comments, after)
            w.start(columns)
            for batch in kept if layout != "row" else ([pa.Table.from_batches(kept).combine_chunks().to_batches()[0]] if kept else []):
                w.write(batch)
            if sink is not None:
                with pa.memory_map(spool.path) as m:
                    reader = pa.ipc.open_file(m)
                    for k in range(reader.num_record_batches):
                        w.write(reader.get_batch(k))
            w.finish()
            return w.rows
    finally:
        if os.path.exists(spool.path):
            os.remove(spool.path)


#: Bytes of records of a data block that a task of several writes.
BLOCK_BYTES = 4 << 20


def sized(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many."""
    held, n = [], 0
    for b in batches:
        k = 0
        while k < b.num_rows:
            part = b.slice(k, rows - n)
            held, n, k = [*held, part], n + part.num_rows, k + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def record_bytes(columns: list[Column]) -> int:
    return max(1, sum(c.width * int(np.prod(c.shape, dtype=np.int64)) for c in columns) + (len(columns) + 7) // 8)


class Written(WriterCommitMessage):
    def __init__(self, path: str, order: int):
        self.path, self.order = path, order


def new_folder(path: str) -> str:
    own = local(path)
    if own is None:
        raise ValueError("measurement files are written to local or mounted folders only")
    return os.path.join(own, f"_temporary-{uuid.uuid4().hex}")


def write_part(staging: str, batches: Iterator[pa.RecordBatch], schema: T.StructType, options: dict) -> Written:
    from pyspark import TaskContext

    os.makedirs(staging, exist_ok=True)
    context = TaskContext.get()
    path = os.path.join(staging, f"part-{context.partitionId():05d}-{context.taskAttemptId()}.mf4")
    write_file(path, batches, schema, options.get("layout", "columns"), options.get("compression") or None, int(options.get("startns", 0)))
    return Written(path, context.partitionId())


def publish(path: str, staging: str, messages: list, overwrite: bool) -> None:
    own = local(path)
    os.makedirs(own, exist_ok=True)
    before = [os.path.join(own, x) for x in os.listdir(own) if x.lower().endswith(".mf4")] if overwrite else []
    tag = uuid.uuid4().hex[:8]
    for m in messages:
        if m is not None:
            os.replace(m.path, os.path.join(own, f"part-{m.order:05d}-{tag}.mf4"))
    for x in before:
        os.remove(x)
    discard(staging)


def discard(staging: str) -> None:
    shutil.rmtree(staging, ignore_errors=True)
