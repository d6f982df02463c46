"""What the operators of this subpackage share: checkpoints, size checks and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_base, ship

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: below spark.checkpoint.dir, or a local one where that may be."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(spark))
    return context.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, so a lost executor costs no recomputation.

    rows: what df has at most, where that is known. Then no more files are written than per_file asks for, as small
    tables over many partitions are mostly the cost of files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // per_file)))).checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has no more than that many rows, else df as it is (a shuffle join follows).

    df is counted, so it should be cheap to read: a checkpoint, or little more than one.
    """
    return F.broadcast(df) if df.count() <= rows else df


def text_of(column: str) -> Column:
    """A text column whose null counts as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Applies function to every Arrow batch; no state passes from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return map_arrow(df, run, schema)
