"""Measurement files as tables: what they hold, their channels as DataFrames, edits and exports."""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.conversion import to_physical
from .operators.tables import q
from .session import ship
from .sources import parts
from .sources.datasource import MdfDataSource, table_schema
from .sources.decode import ROW
from .sources.files import listed, local
from .sources.model import Meta, Table
from .sources.read import read_meta
from .sources.writer import BLOCK_BYTES, Spool, Writer, column_of, record_bytes, sized

#: Names of Parquet codecs, and those that Spark knows under another name.
CODECS = {"snappy": "snappy", "gzip": "gzip", "lzo": "lzo", "brotli": "brotli", "lz4": "lz4", "lz4raw": "lz4_raw", "zstd": "zstd", "none": "none", "uncompressed": "none"}


def register(spark: SparkSession) -> None:
    """Makes the format "mdf" known to the session, which may then push filters down to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MdfDataSource)


def physical(df: DataFrame, table: Table) -> DataFrame:
    """Raw columns with their conversions applied; units and descriptions stay with them."""
    channels = {c.name: c for _, c in table.columns()}
    out = []
    for f in df.schema:
        c = channels.get(f.name)
        value = to_physical(q(f.name), f.dataType, c.conversion)[0] if c else q(f.name)
        out.append(value.alias(f.name, metadata=f.metadata or {}))
    return df.select(*out)


class MdfFile:
    """A measurement file. Metadata are read once, on the driver; data only when an action asks for them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        files = listed(path)
        if not files:
            raise FileNotFoundError(path)
        self.meta: Meta = read_meta(files[0])
        register(spark)

    # What the file says of itself

    @property
    def version(self) -> int:
        return self.meta.version

    def channel_names(self) -> list[str]:
        return sorted(c.name for t in self.meta.tables() for _, c in t.columns())

    def masters(self) -> dict[str | None, list[str]]:
        """Master -> its channels; None for channels without one."""
        out: dict[str | None, list[str]] = {}
        for t in self.meta.tables():
            out.setdefault(t.master.name if t.master else None, []).extend(c.name for _, c in t.columns())
        return {k: sorted(v) for k, v in out.items()}

    def _channel(self, name: str):
        return next(c for _, c in self.meta.table_of(name).columns() if c.name == name)

    def unit(self, name: str) -> str:
        return self._channel(name).unit

    def description(self, name: str) -> str:
        return self._channel(name).description

    def master(self, name: str) -> str | None:
        m = self.meta.table_of(name).master
        return m.name if m else None

    def master_type(self, name: str) -> int:
        m = self.meta.table_of(name).master
        return m.sync if m else 0

    def dtype(self, name: str) -> T.DataType:
        """The type of a channel's physical values."""
        table = self.meta.table_of(name)
        f = table_schema(table, [name])[name]
        return to_physical(F.lit(None).cast(f.dataType), f.dataType, self._channel(name).conversion)[1]

    # Metadata as DataFrames

    def channels(self) -> DataFrame:
        rows = []
        for n, t in enumerate(self.meta.tables()):
            for g, c in t.columns():
                s = c.source
                rows.append((n, g.index, g.name, c.name, c.unit, c.description, t.master.name if t.master else None, c.kind, c.sync, c.data_type, c.bit_count, c.conversion.kind if c.conversion else None, t.rows, s.name if s else None, s.path if s else None, s.bus if s else None))
        return self.spark.createDataFrame(rows, "table int, group int, group_name string, name string, unit string, description string, master string, channel_type int, sync_type int, data_type int, bit_count int, conversion int, rows long, source_name string, source_path string, source_bus int")

    def header(self) -> DataFrame:
        m = self.meta
        row = (m.path, m.version, m.program, m.start_ns, m.tz_minutes, m.dst_minutes, m.time_flags, m.comments)
        return self.spark.createDataFrame([row], "file string, version int, program string, start_ns long, tz_minutes int, dst_minutes int, time_flags int, comments map<string,string>").withColumn("start_time", F.timestamp_micros(F.expr("start_ns div 1000")))

    def attachments(self) -> DataFrame:
        rows = [(a.name, a.mime, a.comment, a.flags, a.md5, a.size, a.data, a.intact) for a in self.meta.attachments]
        return self.spark.createDataFrame(rows, "name string, mime string, comment string, flags int, md5 string, size long, data binary, intact boolean")

    def events(self) -> DataFrame:
        rows = [(e.name, e.comment, e.kind, e.sync, e.range_kind, e.cause, e.flags, e.base, e.factor, e.base * e.factor) for e in self.meta.events]
        return self.spark.createDataFrame(rows, "name string, comment string, type int, sync_type int, range_type int, cause int, flags int, sync_base long, sync_factor double, value double")

    def file_history(self) -> DataFrame:
        rows = [(h.time_ns, h.tz_minutes, h.dst_minutes, h.comment, h.tags) for h in self.meta.history]
        return self.spark.createDataFrame(rows, "time_ns long, tz_minutes int, dst_minutes int, comment string, tags map<string,string>")

    def arrays(self) -> DataFrame:
        """Array channels: shape and what the file says of their axes, one row for each composition."""
        rows = [(c.name, list(c.shape), c.order, a.kind, a.storage, a.flags, a.axes, a.cycle_counts, a.links) for t in self.meta.tables() for _, c in t.columns() for a in c.arrays]
        return self.spark.createDataFrame(rows, "name string, shape array<long>, order string, array_type int, storage int, flags long, axes array<array<double>>, cycle_counts array<long>, links map<string,array<long>>")

    def describe(self) -> DataFrame:
        """For each channel its unit, description, and its first and last value as text, by row number."""
        out = []
        for k, t in enumerate(self.meta.tables()):
            df = self.table(k, rows=True)
            ends = df.agg(*[f(q(c).cast("string"), q(ROW)).alias(f"{n}{i}") for i, c in enumerate(x for x in df.columns if x != ROW) for n, f in (("first", F.min_by), ("last", F.max_by))])
            names = [x for x in df.columns if x != ROW]
            cells = [F.struct(F.lit(t.master.name if t.master else None).cast("string").alias("master"), F.lit(c).alias("name"), F.lit(df.schema[c].metadata.get("unit", "")).alias("unit"), F.lit(df.schema[c].metadata.get("description", "")).alias("description"), F.col(f"first{i}").alias("first"), F.col(f"last{i}").alias("last")) for i, c in enumerate(names)]
            if cells:
                out.append(ends.select(F.explode(F.array(*cells)).alias("r")).select("r.*"))
        return _union(out) if out else self.spark.createDataFrame([], "master string, name string, unit string, description string, first string, last string")

    # Data

    def tables(self) -> list[DataFrame]:
        return [self.table(k) for k in range(len(self.meta.tables()))]

    def table(self, number: int = 0, channels: Iterable[str] | None = None, raw: bool = False, rows: bool = False) -> DataFrame:
        """A table by number; only the named channels are decoded. rows keeps the row number."""
        reader = self.spark.read.format("mdf").option("path", self.path).option("group", number)
        if channels is not None:
            reader = reader.option("channels", json.dumps(list(channels)))
        df = reader.load()
        df = df if raw else physical(df, self.meta.tables()[number])
        return df if rows else df.drop(ROW)

    def group(self, of: str, **options) -> DataFrame:
        """The table that a channel is in."""
        return self.table(next(k for k, t in enumerate(self.meta.tables()) if t.index == self.meta.table_of(of).index), **options)

    def select(self, *names: str, raw: bool = False) -> DataFrame:
        """Channels of one table, in that order."""
        return self.group(names[0], channels=names, raw=raw).select(*map(q, names))

    def window(self, of: str, low: float | None = None, high: float | None = None, **options) -> DataFrame:
        """The rows of a channel's table whose master is in low to high, both included. With an increasing linear conversion
        (or none) the bounds are taken back to raw values, so only these rows are read."""
        table = self.meta.table_of(of)
        name = table.master.name if table.master else None
        if name is None:
            raise ValueError(f"{of!r} has no master")
        number = next(k for k, t in enumerate(self.meta.tables()) if t.index == table.index)
        df = self.table(number, raw=True, **options)
        c = table.master.conversion
        values = c.values if c is not None and c.kind == (1 if c.version == 4 else 0) else [0.0, 1.0] if c is None else []
        for bound, lower in ((low, True), (high, False)):
            if bound is not None and len(values) >= 2 and values[1] > 0:
                # Loosened by more than rounding can be off; the physical values decide below.
                raw = (bound - values[0]) / values[1]
                slack = 1e-9 * (abs(raw) + abs(bound / values[1]) + abs(values[0] / values[1]))
                edge = F.lit(float(raw - slack if lower else raw + slack)).cast("double")
                kind = df.schema[name].dataType
                if isinstance(kind, T.IntegralType):
                    whole = math.floor(raw - slack) if lower else math.ceil(raw + slack)
                    if abs(whole) >= 1 << 63:
                        continue
                    edge = F.lit(whole).cast(kind) if abs(whole) < 1 << (8 * {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}[kind.simpleString()] - 1) else None
                if edge is not None:
                    df = df.where(q(name) >= edge if lower else q(name) <= edge)
        df = physical(df, table)
        for bound, lower in ((low, True), (high, False)):
            if bound is not None:
                df = df.where(q(name) >= bound if lower else q(name) <= bound)
        return df if options.get("rows") else df.drop(ROW)

    # Exports

    def export_parquet(self, folder: str, compression: str | None = None, only: str | None = None) -> list[str]:
        """A Parquet data set for each table (or that of a channel only), named by number and master. Beside unit and
        description, each column's metadata (kept in the file's schema) have file_name and master_channel."""
        codec = CODECS[(compression or "none").lower()]
        base, out = os.path.splitext(os.path.basename(self.path.rstrip("/")))[0], []
        for k, t in enumerate(self.meta.tables()):
            if only is None or any(c.name == only for _, c in t.columns()):
                tag = re.sub(r"\W+", "_", t.master.name if t.master else "no_master")
                out.append(f"{folder.rstrip('/')}/{base}_{k}_{tag}.parquet")
                df, said = self.table(k), {"file_name": os.path.basename(self.path), "master_channel": t.master.name if t.master else ""}
                df = df.select(*[q(f.name).alias(f.name, metadata={**(f.metadata or {}), **said}) for f in df.schema])
                df.write.option("compression", codec).mode("overwrite").parquet(out[-1])
        return out

    def export_hdf5(self, path: str, compression: str | None = None) -> None:
        """One HDF5 file, a group for each table, filled in Arrow batches, row range by row range; needs h5py.

        Numbers, texts, fixed arrays of numbers and times (as nanoseconds) are written; a channel of another type is refused. Nulls
        are NaN, 0 or the empty text, and true in a data set beside it with the ending _null.
        """
        try:
            import h5py
        except ImportError as e:
            raise ImportError("HDF5 export needs the package h5py") from e
        with h5py.File(path, "w") as out:
            for k, t in enumerate(self.meta.tables()):
                g = out.create_group(f"{k}_{t.master.name if t.master else 'no_master'}".replace("/", "_"))
                df = self.table(k)  # partitions are row ranges in order
                for f in df.schema:
                    hdf5_type(f)
                sets: dict = {}
                for batch in arrow_batches(df):
                    for f, column in zip(df.schema, batch.columns, strict=True):
                        append_hdf5(h5py, g, sets, f, column, compression)

    def write(self, path: str, compression: bool = False) -> MdfFile:
        """All tables as one MDF 4.2 file, one after the other."""
        write_tables([self.table(k, rows=True).orderBy(ROW).drop(ROW) for k in range(len(self.meta.tables()))], path, compression=compression, start_ns=self.meta.start_ns, comments=self.meta.comments)
        return MdfFile(self.spark, path)

    def add_table(self, df: DataFrame, layout: str = "columns", compression: bool | str = False) -> MdfFile:
        """This file with df as one more channel group, with a master and a length of its own, behind those that are there."""
        if self.version < 400:
            raise ValueError("tables are added to files of version 4; write() makes one")
        save(df, self.path, layout, compression, append=True)
        return MdfFile(self.spark, self.path)

    def thinned(self, name: str, points: int = 4000) -> DataFrame:
        """A channel beside its master for drawing: of each of points stretches of rows the rows of its least and its greatest
        value, in order; all rows if there are no more than that. Grouped by row number, so no key is hot."""
        table = self.meta.table_of(name)
        m = table.master.name if table.master else None
        df = self.group(name, channels=[*([m] if m and m != name else []), name], rows=True)
        if table.rows <= 2 * points:
            return df.orderBy(ROW).drop(ROW)
        row = F.struct(*map(q, df.columns))
        ends = df.groupBy(F.floor(q(ROW) * points / table.rows).alias("__p")).agg(F.min_by(row, q(name)).alias("a"), F.max_by(row, q(name)).alias("b"))
        return ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("r")).select("r.*").orderBy(ROW).drop(ROW)

    def plot(self, name: str):
        """The channel over its master, by matplotlib if that is installed; long channels are thinned first."""
        m = self.master(name)
        return self.thinned(name).toPandas().plot(x=m if m != name else None, y=name)


def arrow_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """Batches of a DataFrame in order, one partition at a time on the driver. As bytes, so all types pass alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    for row in plain.mapInArrow(run, "batch binary").toLocalIterator(prefetchPartitions=False):
        with pa.ipc.open_stream(row["batch"]) as r:
            yield from r


_HDF5 = {"boolean": "i1", "tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8", "timestamp": "i8", "timestamp_ntz": "i8", "decimal(20,0)": "u8"}


def hdf5_type(f: T.StructField) -> str | None:
    """The number format of a channel (None: text); raises for what is not written."""
    kind = f.dataType
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    name = kind.simpleString()
    if name != "string" and name not in _HDF5 or name == "string" and isinstance(f.dataType, T.ArrayType):
        raise TypeError(f"{f.name}: {f.dataType.simpleString()} cannot be exported")
    return _HDF5.get(name)


def hdf5_values(f: T.StructField, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A batch of a channel as HDF5 has it, and which rows are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    kind = hdf5_type(f)
    if isinstance(f.dataType, T.ArrayType):
        shape, first = [], next((x for x in column.to_pylist() if x is not None), [])
        while isinstance(first, list):
            shape.append(len(first))
            first = first[0] if first else None
        return np.array([np.zeros(shape) if x is None else x for x in column.to_pylist()], dtype=kind).reshape(len(column), *shape), null
    if kind is None:
        return np.array(column.fill_null("").to_pylist(), dtype=object), null
    if pa.types.is_timestamp(column.type):
        column = pc.multiply(column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()), 1000)
    elif pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    elif pa.types.is_decimal(column.type):
        column = column.cast(pa.uint64())
    return column.fill_null(float("nan") if kind[0] == "f" else 0).to_numpy(zero_copy_only=False).astype(kind), null


def append_hdf5(h5py, group, sets: dict, f: T.StructField, column: pa.Array, compression: str | None) -> None:
    values, null = hdf5_values(f, column)
    name = f.name.replace("/", "_")
    for key, some in ((name, values), (f"{name}_null", null)):
        if key == f"{name}_null" and key not in sets and not null.any():
            continue
        if key not in sets:
            before = len(sets[name]) - len(null) if key != name else 0
            kind = h5py.string_dtype() if some.dtype == object else some.dtype
            sets[key] = group.create_dataset(key, shape=(before, *some.shape[1:]), maxshape=(None, *some.shape[1:]), chunks=True, dtype=kind, compression=compression)
            for attribute in ("unit", "description", "sync_type"):
                sets[key].attrs[attribute] = (f.metadata or {}).get(attribute, "")
        sets[key].resize(len(sets[key]) + len(some), axis=0)
        sets[key][len(sets[key]) - len(some) :] = some


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_tables(tables: list[DataFrame], path: str, **options) -> None:
    """Several DataFrames, with masters of their own, as the tables of one file, each behind those before."""
    to = local(path)
    if to is None:
        raise ValueError("measurement files are written to local or mounted folders only")
    part = f"{to}.{uuid.uuid4().hex}.part"
    try:
        for k, df in enumerate(tables):
            save(df, part, append=k > 0, **options)
        os.replace(part, to)
    finally:
        if os.path.exists(part):
            os.remove(part)


def save(df: DataFrame, path: str, layout: str = "columns", compression: bool | str = False, start_ns: int = 0, comments: dict[str, str] | None = None, append: bool = False) -> None:
    """df as one measurement file, written by a task for each partition, each to its own stretch of the file: rows come in
    order of the partitions. append: as one more table of a file that is there (it should not be read meanwhile; what an
    attempt that failed has left behind the old end is not linked).

    Texts, bytes and arrays need their widths in advance, so their batches are spooled once, beside the file. A folder of
    files comes from df.write.format("mdf"). The path must be one that executors and driver share.
    """
    how = ("transpose" if compression == "transpose" else "deflate") if compression else None
    schema, to, spark = df.schema, local(path), df.sparkSession
    if to is None:
        raise ValueError("measurement files are written to local or mounted folders only")
    ship(spark)
    kinds = [column_of(f, 1) for f in schema]  # raises for what cannot be written
    names = schema.names
    os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
    with parts.folder(to) as into:
        if any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType)) for f in schema):

            def spool(batches, f):
                seen = Spool("")
                parts.arrow((b.rename_columns(names) for b in batches), f, seen.note)
                return seen

            raw = parts.spooled(df, into, spool)
            widths = {n: max([1, *(p.said.widths.get(n, 1) for p in raw)]) for n in names}
            shapes = {n: next((p.said.shapes[n] for p in raw if n in p.said.shapes), (1,) if isinstance(schema[n].dataType, T.ArrayType) else ()) for n in names}
            columns = [column_of(f, widths[f.name], shapes[f.name]) for f in schema]

            def encode(p):
                with open(f"{into}/{uuid.uuid4().hex}", "wb") as f:  # a task that runs twice must not write over its own part
                    said = written(parts.batches(p.path), f, columns, layout, how)
                return parts.Part(f.name, os.path.getsize(f.name), said)

            made = parts.everywhere(spark, raw, encode)
            for p in raw:
                os.remove(p.path)
        else:
            columns = kinds
            made = parts.spooled(df, into, lambda batches, f: written(batches, f, columns, layout, how))
        stream = [(p.path, p.size) for p in made]
        after = os.path.getsize(to) if append else None
        whole = to if append else f"{into}/whole"
        with open(whole, "r+b" if append else "w+b") as f:
            w = Writer(f, "rows" if layout == "row" else layout, how, start_ns, comments, after)
        w.start(columns)
        w.rows = sum(p.said[0] for p in made)
        if layout == "row" and how != "transpose":
            blocks, end = parts.laid(spark, whole, w.at, stream, into, compression=how)
            w.blocks = {0: blocks} if blocks else {}
        else:
            end = w.at
            for p in made:
                for k, some in p.said[1].items():
                    w.blocks.setdefault(k, []).extend((end + at, n) for at, n in some)
                for k, some in p.said[2].items():
                    w.invalid.setdefault(k, []).extend(end + at for at in some)
                end += p.size
            parts.copied(spark, whole, w.at, stream)
        with open(whole, "r+b") as f:
            f.seek(end)
            w.f, w.at = f, end
            w.finish()
        if not append:
            os.replace(whole, to)


def written(batches: Iterator[pa.RecordBatch], f: BinaryIO, columns: list, layout: str, how: str | None) -> tuple[int, dict, dict]:
    """Writes a part's data blocks (for one block in all: its records) and returns its rows and the blocks' places."""
    w = Writer(f, "rows" if layout == "row" else layout, how, part=True)
    w.start(columns)
    for batch in sized(batches, max(1, BLOCK_BYTES // record_bytes(columns))):
        if layout == "row" and how != "transpose":
            f.write(w.records(batch).tobytes())
            w.rows += batch.num_rows
        else:
            w.write(batch)
    return w.rows, w.blocks, w.invalid


# Edits: tables are immutable, an edit is a new table

def with_metadata(df: DataFrame, name: str, **values) -> DataFrame:
    """Unit, description or other metadata of a column, whose name may hold dots and the like."""
    return df.select(*[q(f.name).alias(f.name, metadata={**(f.metadata or {}), **(values if f.name == name else {})}) for f in df.schema])


def set_unit(df: DataFrame, name: str, unit: str) -> DataFrame:
    return with_metadata(df, name, unit=unit)


def set_description(df: DataFrame, name: str, description: str) -> DataFrame:
    return with_metadata(df, name, description=description)


def set_master(df: DataFrame, name: str, sync_type: int = 1) -> DataFrame:
    """Makes a column the master of its table."""
    return df.select(*[q(f.name).alias(f.name, metadata={**(f.metadata or {}), "master": name, **({"sync_type": sync_type} if f.name == name else {})}) for f in df.schema])


def add_channel(df: DataFrame, name: str, value: Column, unit: str = "", description: str = "") -> DataFrame:
    if name in df.columns:
        raise ValueError(f"there is a channel {name!r}")
    master = next((f.metadata.get("master") for f in df.schema if f.metadata and f.metadata.get("master")), "")
    return df.select(*map(q, df.columns), value.alias(name, metadata={"unit": unit, "description": description, "master": master, "sync_type": 0}))


def set_data(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(name, metadata=f.metadata or {}) if f.name == name else q(f.name) for f in df.schema])


def remove_channel(df: DataFrame, name: str) -> DataFrame:
    return df.drop(q(name))


def rename_channel(df: DataFrame, name: str, new: str) -> DataFrame:
    """Renames a column; where it is the master, the others follow."""
    follow = lambda f: {**(f.metadata or {}), "master": new} if (f.metadata or {}).get("master") == name else f.metadata or {}
    return df.select(*[q(f.name).alias(new if f.name == name else f.name, metadata=follow(f)) for f in df.schema])
