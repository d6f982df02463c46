"""The Spark data source "mdf": channel groups of measurement files as DataFrames.

Options: path (a file, folder or pattern), group (number of the table, 0 by default) or groupOf (a channel of it), channels
(a JSON list of names: only these are decoded), partitionBytes. Columns are raw values; _row numbers the rows over all
files, in order of their names. Files of one path must have the same channels in that table; a channel that one of them
lacks is null there. Metadata are read on the driver, data by the tasks: each opens the file itself and reads its rows' bytes.

Comparisons of _row, or of the raw values of a table's master, with numbers are pushed down: only row ranges that can hold
such rows are planned. For the master they are found by bisection, a few records each; the format has masters ascend. Where a
file may break that, the option masterSorted=false leaves it out.

Writing ("append" or "overwrite" of a folder): each task streams its rows into one MDF 4.2 file of its own; the driver
moves the finished files into place, so a task that is run again leaves nothing behind.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..plans.partitions import PARTITION_BYTES, RowRange, row_ranges
from .decode import ROW, GroupReader, arrow_type, read_rows
from .files import listed, open_input
from .model import Channel, Meta, Table
from .read import read_meta, read_metas


def column_metadata(c: Channel, table: Table) -> dict:
    """What Spark keeps beside a column: unit, description, master."""
    out: dict = {"unit": c.unit, "description": c.description, "sync_type": c.sync, "master": table.master.name if table.master else ""}
    if c.shape:
        out |= {"shape": list(c.shape), "order": c.order}
        if any(a.axes for a in c.arrays):
            out |= {f"axis_{k}": axis for k, axis in enumerate(x for a in c.arrays for x in a.axes)}  # Spark's metadata do not nest lists
    return out


def table_schema(table: Table, names: list[str] | None = None) -> T.StructType:
    chosen = [(g, c) for g, c in table.columns() if names is None or c.name in names]
    plain = from_arrow_schema(pa.schema([pa.field(ROW, pa.int64()), *(pa.field(c.name, arrow_type(c)) for _, c in chosen)]))
    extra = {c.name: column_metadata(c, table) for _, c in chosen}
    return T.StructType([T.StructField(f.name, f.dataType, True, extra.get(f.name)) for f in plain])


def pick(meta: Meta, options: dict) -> Table:
    if "groupof" in options:
        return meta.table_of(options["groupof"])
    tables = meta.tables()
    at = int(options.get("group", 0))
    if not 0 <= at < len(tables):
        raise ValueError(f"{meta.path} has {len(tables)} tables, not one number {at}")
    return tables[at]


class MdfPartition(InputPartition):
    def __init__(self, rows: RowRange):
        super().__init__(rows)


class MdfReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names = options, [f.name for f in schema]
        self.arrow = to_arrow_schema(schema)
        self.bounds: dict[str, list[tuple[str, float]]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes bounds of columns; Spark still applies every filter itself."""
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and isinstance(f.value, (int, float)) and not isinstance(f.value, bool):
                self.bounds.setdefault(f.attribute[0], []).append((kinds[type(f)], f.value))
            yield f

    def window(self, path: str, table: Table, first: int) -> tuple[int, int]:
        """The rows of a file that the noted bounds leave: those outside cannot pass."""
        low, high = 0, table.rows
        for how, value in self.bounds.get(ROW, []):
            if how in (">", ">=", "=="):
                low = max(low, math.ceil(value) - first)
            if how in ("<", "<=", "=="):
                high = min(high, math.floor(value) + 1 - first)
        group, master = table.groups[0], table.master
        bounds = self.bounds.get(master.name, []) if master else []
        if bounds and group.sorted and low < high and not master.virtual and str(self.options.get("mastersorted", "true")).lower() != "false":
            with open_input(path) as f:
                reader = GroupReader(f, group, {master.name})
                at = lambda row: reader.columns(row, row + 1)[master.name][0].as_py()
                ends = at(low), at(high - 1)
                if all(isinstance(v, (int, float)) and v == v for v in ends) and ends[0] <= ends[1]:
                    for how, value in bounds:
                        if how in (">", ">=", "=="):
                            low = max(low, bisect_left(range(table.rows), value, low, max(low, high), key=at))
                        if how in ("<", "<=", "=="):
                            high = min(high, bisect_right(range(table.rows), value, min(low, high), high, key=at))
        return max(0, low), max(0, high)

    def partitions(self) -> list[MdfPartition]:
        out: list[MdfPartition] = []
        first, target = 0, int(self.options.get("partitionbytes", PARTITION_BYTES))
        paths = listed(self.options["path"])
        for path, meta in zip(paths, read_metas(paths), strict=True):
            table = pick(meta, self.options)
            own = [c.name for _, c in table.columns() if c.name in self.names]
            low, high = self.window(path, table, first) if self.bounds else (0, table.rows)
            if low < high:
                out += [MdfPartition(r) for r in row_ranges(path, meta.version, table, own, first, target, low, high)]
            first += table.rows
        return out

    def read(self, partition: MdfPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None and getattr(partition, "value", None) is not None:
            yield from read_rows(partition.value, self.arrow)


class MdfWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.options, self.schema, self.overwrite = options, schema, overwrite
        from .writer import new_folder

        self.path = options["path"]
        self.staging = new_folder(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from .writer import write_part

        return write_part(self.staging, iterator, self.schema, self.options)

    def commit(self, messages: list) -> None:
        from .writer import publish

        publish(self.path, self.staging, messages, self.overwrite)

    def abort(self, messages: list) -> None:
        from .writer import discard

        discard(self.staging)


class MdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mdf"

    def lower(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> T.StructType:
        options = self.lower()
        files = listed(options["path"])
        if not files:
            raise FileNotFoundError(options["path"])
        names = json.loads(options["channels"]) if "channels" in options else None
        return table_schema(pick(read_meta(files[0], False), options), names)

    def reader(self, schema: T.StructType) -> MdfReader:
        return MdfReader(self.lower(), schema)

    def streamReader(self, schema: T.StructType):
        from ..streaming.files import MdfStreamReader

        return MdfStreamReader(self.lower(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> MdfWriter:
        return MdfWriter(self.lower(), schema, overwrite)
