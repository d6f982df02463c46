import io
import struct
import zlib

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chanspark import mdf
from chanspark.plans.partitions import Stream
from chanspark.sources import samples
from chanspark.sources.read import read_meta
from chanspark.sources.samples import Field

FIELDS = [Field("task", 2, 64, 0), Field("id", 2, 64, 8), Field("x", 4, 64, 16)]


def numbered(spark, n, partitions=4):
    """Rows with the number of the task that sees them; some partitions are empty."""
    task = F.udf(lambda: TaskContext.get().partitionId(), "long").asNondeterministic()
    df = spark.range(0, n, 1, partitions).where("id < 1 or id >= 3")
    return df.select(task().alias("task"), "id", (F.hash("id") % 1000 / F.lit(7.0)).alias("x"))


def same(df, want):
    got = sorted(map(tuple, df.collect()))
    tasks = {r[0] for r in got}
    assert [r[1:] for r in got] == sorted(tuple(r)[1:] for r in want.collect()) and len(tasks) > 1
    return got


class Counting(io.FileIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        Counting.taken += len(data)
        return data


def test_one_compressed_block_is_read_in_its_middle(spark, tmp_path):
    """A row range opens the pieces it is in, not the block from its start; others read the block as one stream."""
    path, n = str(tmp_path / "dz.mf4"), 300_000
    df = numbered(spark, n)
    samples.straddling(df, path, ["<i8", "<i8", "<f8"], FIELDS, compression="deflate", listed=False)
    group = read_meta(path).groups[0]
    data = open(path, "rb").read()
    at = group.stream[0].offset - 50
    assert data[at : at + 4] == b"##DZ" and data.count(b"##DZ") == 1
    size, stored = struct.unpack_from("<QQ", data, at + 32)
    plain = zlib.decompress(data[at + 48 : at + 48 + stored])
    assert len(plain) == size == 24 * (n - 2) and len(group.stream) > 5
    with Counting(path) as f:
        assert Stream(f, group.stream).read(size - 24, size) == plain[-24:]
    assert Counting.taken < stored / 4
    same(mdf.MdfFile(spark, path).table(0), df)


@pytest.mark.parametrize("how", [{}, {"listed": False}, {"header": True, "compression": "deflate"}, {"listed": False, "compression": "deflate"}, {"bite": 1001}])
def test_records_are_written_by_every_task(spark, tmp_path, how):
    path, n = str(tmp_path / "a.mf4"), 20_000
    df = numbered(spark, n)
    samples.straddling(df, path, ["<i8", "<i8", "<f8"], FIELDS, **how)
    file = mdf.MdfFile(spark, path)
    same(file.table(0), df)
    assert [r.id for r in file.table(0, rows=True).orderBy("_row").collect()] == [r.id for r in df.collect()]
    blocks = open(path, "rb").read()
    assert not (how.get("listed") is False) or blocks.count(b"##DT") + blocks.count(b"##DZ") == 1
    samples.straddling(df.limit(0), path, ["<i8", "<i8", "<f8"], FIELDS, **how)
    assert mdf.MdfFile(spark, path).table(0).count() == 0


@pytest.mark.parametrize("layout", ["columns", "rows", "row"])
@pytest.mark.parametrize("how", [False, True, "transpose"])
@pytest.mark.parametrize("texts", [False, True])
def test_tables_are_written_by_every_task(spark, tmp_path, layout, how, texts):
    """Texts grow from partition to partition, so no task knows their width; arrays and nulls come back as well."""
    path, n = str(tmp_path / "a.mf4"), 5_000
    df = numbered(spark, n).withColumn("some", F.when(F.col("id") % 3 == 0, F.col("id")))
    if texts:
        df = df.withColumns({"text": F.expr("repeat('é', cast(id div 100 as int))"), "list": F.array("x", "x")})
    mdf.save(df, path, layout, how)
    file = mdf.MdfFile(spark, path)
    got = [tuple(r) for r in file.table(0, rows=True).orderBy("_row").drop("_row").collect()]
    assert [r[1:] for r in got] == [tuple(r)[1:] for r in df.collect()] and len({r[0] for r in got}) > 1
    mdf.save(mdf.rename_channel(df.select("task", "id"), "id", "more").withColumnRenamed("task", "again"), path, layout, how, append=True)
    both = mdf.MdfFile(spark, path)
    assert sorted(both.group("more").select("more").toPandas()["more"]) == [r[1] for r in got] and both.group("id").count() == n - 2
    if layout == "row" and not how:
        assert open(path, "rb").read().count(b"##DT") == 2
    assert [p.name for p in tmp_path.iterdir()] == ["a.mf4"]
    mdf.save(df.limit(0), path, layout, how)
    assert mdf.MdfFile(spark, path).table(0).count() == 0


@pytest.mark.parametrize("in_group", [False, True])
def test_variable_values_are_written_by_every_task(spark, tmp_path, in_group):
    """The places of the values go on from partition to partition."""
    path = str(tmp_path / "v.mf4")
    df = numbered(spark, 5_000).select("id", F.concat(F.col("task").cast("string"), F.lit(" "), F.expr("repeat('ü', cast(id % 7 as int))")).alias("text"))
    samples.variables(df, path, in_group)
    got = sorted(map(tuple, mdf.MdfFile(spark, path).group("key").select("key", "value").collect()))
    cut = lambda rows: [(k, t.split(" ")[1]) for k, t in rows]
    assert cut(got) == cut(sorted(map(tuple, df.collect()))) and len({t.split(" ")[0] for _, t in got}) > 1
    samples.variables(df.limit(0), path, in_group)
    assert mdf.MdfFile(spark, path).group("key").count() == 0


@pytest.mark.parametrize("compression", [None, "deflate"])
def test_mixed_records_are_written_by_every_task(spark, tmp_path, compression):
    path = str(tmp_path / "m.mf4")
    df = numbered(spark, 20_000).select((F.col("id") % 3 == 0).cast("int").alias("tag"), "id", F.col("task").cast("double").alias("value"))
    samples.mixture(df, path, 2, compression)
    file = mdf.MdfFile(spark, path)
    a, b = ([tuple(r) for r in file.group(k).collect()] for k in ("key_a", "key_b"))
    ids = [r.id for r in df.collect()]
    assert [r[0] for r in a] == [k for k in ids if k % 3] and [(r[0], r[2]) for r in b] == [(k, k % 7) for k in ids if not k % 3]
    assert len({r[1] for r in a}) > 1


def test_version3_is_written_by_every_task(spark, tmp_path):
    path = str(tmp_path / "a.mdf")
    df = numbered(spark, 5_000)
    channels = [{"name": n, "type": t, "byte": 8 * k, "bits": 64} for k, (n, t) in enumerate((("task", 1), ("id", 1), ("x", 3)))]
    samples.version3_table(df, path, ["<i8", "<i8", "<f8"], channels)
    same(mdf.MdfFile(spark, path).table(0), df)
    assert mdf.MdfFile(spark, path).table(0).schema["x"].dataType == T.DoubleType()
