"""From record bytes to Arrow columns, whole arrays at a time."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa

from ..plans.partitions import RowRange, Stream
from .blocks4 import size_of
from .files import open_input
from .model import Channel, Group, Segment

#: Bytes of records that are decoded at once.
BATCH_BYTES = 4 << 20
#: Bytes of unsorted data that are read at once.
CHUNK_BYTES = 1 << 20
ROW = "_row"

_INTS = {1: (pa.int16(), pa.int8()), 2: (pa.int32(), pa.int16()), 4: (pa.int64(), pa.int32()), 8: (pa.decimal128(20, 0), pa.int64())}


def width_class(n_bytes: int) -> int:
    return next(w for w in (1, 2, 4, 8) if n_bytes <= w or w == 8)


def arrow_type(c: Channel) -> pa.DataType:
    """Type of a channel's raw values. Spark has no unsigned numbers: the next wider type takes their place."""
    if c.virtual:
        return pa.int64()
    if c.kind == 1:
        return pa.string() if 6 <= c.data_type <= 9 else pa.binary()
    t = c.data_type
    if t in (0, 1):
        out = _INTS[width_class(c.n_bytes)][0]
    elif t in (2, 3):
        out = _INTS[width_class(c.n_bytes)][1]
    elif t in (4, 5):
        out = pa.float32() if c.n_bytes <= 4 else pa.float64()
    elif t in (15, 16):
        part = pa.float32() if complex_bytes(c) <= 4 else pa.float64()
        out = pa.struct([("re", part), ("im", part)])
    elif 6 <= t <= 9:
        out = pa.string()
    else:
        out = pa.binary()
    if c.shape and t > 5:
        raise ValueError(f"{c.name}: arrays of data type {t} are not supported")
    for _ in c.shape:
        out = pa.list_(out)
    return out


def complex_bytes(c: Channel) -> int:
    """Bytes of each of the two parts; the bit count covers both of them."""
    return c.n_bytes // 2


def integers(raw: np.ndarray, c: Channel) -> np.ndarray:
    """Unsigned or signed numbers of any width, byte order and bit offset, from bytes (n, width)."""
    signed = c.data_type in (2, 3)
    width = raw.shape[1]
    if not c.bit_offset and c.bit_count == 8 * width and width in (1, 2, 4, 8):
        kind = f"{'>' if c.big_endian else '<'}{'i' if signed else 'u'}{width}"
        return np.ascontiguousarray(raw).view(kind).ravel().astype(kind[1:], copy=False)
    if width > 8:
        raise ValueError(f"{c.name}: an integer over {width} bytes")
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw[:, ::-1] if c.big_endian else raw
    x = wide.view("<u8").ravel() >> np.uint64(c.bit_offset)
    if c.bit_count < 64:
        x &= np.uint64((1 << c.bit_count) - 1)
        if signed:
            up = np.uint64(64 - c.bit_count)
            return (x << up).view(np.int64) >> np.int64(up)
    return x.view(np.int64) if signed else x


def floats(raw: np.ndarray, width: int, big: bool) -> np.ndarray:
    x = np.ascontiguousarray(raw).view(f"{'>' if big else '<'}f{width}").ravel()
    return x.astype("f4" if width <= 4 else "f8", copy=False)


def codec(c: Channel) -> str:
    return {6: "cp1252", 7: "utf-8", 8: "utf-16-le", 9: "utf-16-be"}.get(c.data_type, "utf-8")


def strings(values: list[bytes], c: Channel) -> list[str]:
    name = codec(c)
    if name == "cp1252":  # five bytes have no character there
        return [v.rstrip(b"\0").decode("cp1252", "replace") for v in values]
    return [v.decode(name, "replace").rstrip("\0") for v in values]


def to_arrow(values: np.ndarray, kind: pa.DataType, null: np.ndarray | None) -> pa.Array:
    if pa.types.is_decimal(kind):
        return pa.array(values, pa.uint64(), mask=null).cast(kind)
    return pa.array(values.astype(kind.to_pandas_dtype(), copy=False), kind, mask=null)


def nested(flat: pa.Array, shape: tuple[int, ...], n: int, null: np.ndarray | None) -> pa.Array:
    for k in range(len(shape) - 1, -1, -1):
        lists = n * size_of(shape[:k])
        offsets = np.arange(lists + 1, dtype=np.int32) * shape[k]
        flat = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(null) if not k and null is not None else None)
    return flat


def fixed_column(records: np.ndarray, c: Channel, base: int, null: np.ndarray | None) -> pa.Array:
    """A channel of fixed place from records (n, bytes)."""
    n, kind, at = len(records), arrow_type(c), base + c.byte_offset
    total = c.n_bytes * size_of(c.shape)
    raw = records[:, at : at + total]
    if raw.shape[1] < total:
        raise ValueError(f"{c.name} lies outside its record")
    t = c.data_type
    if c.shape:
        inner = kind
        while pa.types.is_list(inner):
            inner = inner.value_type
        cells = np.ascontiguousarray(raw).reshape(n * size_of(c.shape), c.n_bytes)
        x = integers(cells, c) if t < 4 else floats(cells, c.n_bytes, c.big_endian)
        if c.order == "F" and len(c.shape) > 1:
            x = x.reshape(n, *c.shape[::-1]).transpose(0, *range(len(c.shape), 0, -1)).ravel()
        return nested(to_arrow(x, inner, None), c.shape, n, null)
    if t < 4:
        return to_arrow(integers(raw, c), kind, null)
    if t in (4, 5):
        return to_arrow(floats(raw, c.n_bytes, c.big_endian), kind, null)
    if t in (15, 16):
        w = complex_bytes(c)
        parts = [to_arrow(floats(raw[:, k * w : (k + 1) * w], w, c.big_endian), kind[k].type, None) for k in range(2)]
        return pa.StructArray.from_arrays(parts, ["re", "im"], mask=pa.array(null) if null is not None else None)
    data = np.ascontiguousarray(raw).tobytes()
    values = [data[k : k + total] for k in range(0, n * total, total)] if total else [b""] * n
    return pa.array(strings(values, c) if 6 <= t <= 9 else values, kind, mask=null)


def variable_column(records: np.ndarray, c: Channel, base: int, values: Stream, null: np.ndarray | None) -> pa.Array:
    """A channel whose record holds the place of its value in a stream of lengths and bytes."""
    at = base + c.byte_offset
    places = integers(records[:, at : at + c.n_bytes], Channel("", bit_count=c.bit_count, bit_offset=c.bit_offset, big_endian=c.big_endian)).astype(np.int64)
    if null is not None:
        places = np.where(null, -1, places)
    known = places[places >= 0]
    out: list[bytes] = []
    if len(known):
        low, high = int(known.min()), int(known.max())
        end = high + 4 + int.from_bytes(values.read(high, high + 4), "little")
        data = values.read(low, end)
        for p in (places - low).tolist():
            size = int.from_bytes(data[p : p + 4], "little") if p + low >= 0 else 0
            out.append(data[p + 4 : p + 4 + size] if p + low >= 0 else b"")
    else:
        out = [b""] * len(places)
    text = 6 <= c.data_type <= 9
    return pa.array(strings(out, c) if text else out, arrow_type(c), mask=null)


def null_mask(c: Channel, g: Group, invalid: np.ndarray | None) -> np.ndarray | None:
    """Rows whose value is marked invalid: all of them, or those whose bit is set."""
    if c.flags & 1:
        return np.ones(len(invalid), bool) if invalid is not None else None
    if not c.flags & 2 or invalid is None or not g.inval_bytes:
        return None
    return (invalid[:, c.inval_bit >> 3] & (1 << (c.inval_bit & 7))) != 0


class GroupReader:
    """Columns of a stored group by row range."""

    def __init__(self, f: BinaryIO, g: Group, names: set[str]):
        self.f, self.g = f, g
        self.channels = [c for c in g.channels if c.name in names]
        self.data, self.invalid = Stream(f, g.stream, g.stream_base), Stream(f, g.invalid, g.invalid_base)
        self.values = {c.name: Stream(f, c.values) for c in self.channels if c.kind == 1 and c.values_group is None}
        self.spooled: list = []

    def columns(self, start: int, stop: int) -> dict[str, pa.Array]:
        g, n = self.g, stop - start
        if all(c.virtual for c in self.channels):
            return self.decode(np.zeros((n, 0), np.uint8), None, start)
        size = g.record_size
        records = np.frombuffer(self.data.read(start * size, stop * size), np.uint8).reshape(n, size)
        if not g.columnar:
            invalid = records[:, g.id_size + g.data_bytes :]
        elif g.invalid and g.inval_bytes:
            invalid = np.frombuffer(self.invalid.read(start * g.inval_bytes, stop * g.inval_bytes), np.uint8).reshape(n, g.inval_bytes)
        else:
            invalid = None
        return self.decode(records, invalid, start)

    def decode(self, records: np.ndarray, invalid: np.ndarray | None, start: int) -> dict[str, pa.Array]:
        base, out = 0 if self.g.columnar else self.g.id_size, {}
        for c in self.channels:
            null = null_mask(c, self.g, invalid)
            if c.virtual:
                out[c.name] = pa.array(np.arange(start, start + len(records)), pa.int64(), mask=null)
            elif c.kind == 1:
                out[c.name] = variable_column(records, c, base, self.values[c.name], null)
            else:
                out[c.name] = fixed_column(records, c, base, null)
        return out

    def unsorted(self, rows: int) -> Iterator[dict[str, pa.Array]]:
        """All rows, from records of several groups in turn. Variable values go to a spool file of this task first."""
        ids = {c.name: c.values_group for c in self.channels if c.kind == 1 and c.values_group is not None}
        if ids:
            spools = {k: tempfile.TemporaryFile() for k in set(ids.values())}
            for record_id, data in self.records():
                if record_id in spools:
                    spools[record_id].write(data)
            for name, k in ids.items():
                spools[k].flush()
                self.values[name] = Stream(spools[k], [Segment(0, spools[k].seek(0, 2))])
            self.spooled = list(spools.values())
        done, held, size, own = 0, [], self.g.record_size, self.g.record_id
        most = max(1, BATCH_BYTES // max(1, size))
        for record_id, data in self.records():
            if record_id == own and done + len(held) < rows:
                held.append(data)
                if len(held) == most:
                    yield self.decoded(held, done)
                    done, held = done + len(held), []
        if done + len(held) < rows:
            raise ValueError(f"{rows} records were promised, {done + len(held)} are there")
        if held:
            yield self.decoded(held, done)

    def decoded(self, held: list[bytes], start: int) -> dict[str, pa.Array]:
        records = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), self.g.record_size)
        return self.decode(records, records[:, self.g.id_size + self.g.data_bytes :], start)

    def records(self) -> Iterator[tuple[int, bytes]]:
        """Record id and bytes of each record in turn (for variable length: length and bytes, without the id)."""
        sizes, id_size, at, total = self.g.siblings, self.g.id_size, 0, self.data.size
        data, k = b"", 0
        while True:
            while len(data) - k >= id_size:
                record_id = int.from_bytes(data[k : k + id_size], "little")
                if record_id not in sizes:
                    raise ValueError(f"no group has the record id {record_id}")
                size = sizes[record_id]
                if size is None:
                    if len(data) - k < id_size + 4:
                        break
                    size = id_size + 4 + int.from_bytes(data[k + id_size : k + id_size + 4], "little")
                    if len(data) - k < size:
                        break
                    yield record_id, data[k + id_size : k + size]
                else:
                    if len(data) - k < size:
                        break
                    yield record_id, data[k : k + size]
                k += size
            if at >= total:
                if len(data) > k:
                    raise ValueError("the data end inside a record")
                return
            more = self.data.read(at, min(total, at + CHUNK_BYTES))
            at += len(more)
            data, k = data[k:] + more, 0


def read_rows(part: RowRange, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a row range, with the columns of schema (the row number among them)."""
    names = set(part.channels)
    with open_input(part.path) as f:
        readers = [GroupReader(f, g, names) for g in part.table.groups if any(c.name in names for c in g.channels)]

        def batch(columns: dict[str, pa.Array], start: int, n: int) -> pa.RecordBatch:
            first = part.first + start - part.start
            columns[ROW] = pa.array(np.arange(first, first + n), pa.int64())
            return pa.RecordBatch.from_arrays([columns[x.name] if x.name in columns else pa.nulls(n, x.type) for x in schema], schema=schema)

        if readers and not all(r.g.sorted for r in readers):
            if len(readers) > 1:
                raise ValueError("unsorted data with a borrowed master are not supported")
            at = part.start
            for columns in readers[0].unsorted(part.stop):
                n = len(next(iter(columns.values())))
                yield batch(columns, at, n)
                at += n
            return
        step = max(1, BATCH_BYTES // max(1, sum(max(8, r.g.record_size) for r in readers)))
        for start in range(part.start, part.stop, step):
            stop = min(part.stop, start + step)
            columns: dict[str, pa.Array] = {}
            for r in readers:
                columns |= r.columns(start, stop)
            yield batch(columns, start, stop - start)
