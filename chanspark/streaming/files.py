"""New measurement files in a folder as a stream of rows.

An offset is the list of files that have been read, so each file is read once, whole; files are taken in order of their
names and must be complete when they appear (write elsewhere, then move). Row numbers count within a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.partitions import PARTITION_BYTES, row_ranges
from ..sources.decode import read_rows
from ..sources.files import listed
from ..sources.read import read_meta


class MdfStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names = options, [f.name for f in schema]
        self.arrow = to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": listed(self.options["path"])}

    def partitions(self, start: dict, end: dict) -> list:
        from ..sources.datasource import MdfPartition, pick

        seen, out = set(start["files"]), []
        for path in end["files"]:
            if path not in seen:
                meta = read_meta(path)
                table = pick(meta, self.options)
                own = [c.name for _, c in table.columns() if c.name in self.names]
                out += [MdfPartition(r) for r in row_ranges(path, meta.version, table, own, 0, int(self.options.get("partitionbytes", PARTITION_BYTES)))]
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield from read_rows(partition.value, self.arrow)

    def commit(self, end: dict) -> None:
        pass
