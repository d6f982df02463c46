import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chanspark import mdf
from chanspark.__main__ import main
from chanspark.plans.partitions import RowRange, Stream
from chanspark.sources.decode import ROW, arrow_type, integers, read_rows
from chanspark.sources.model import Channel, Conversion, Segment
from chanspark.sources.read import read_meta
from chanspark.sources.samples import Builder, Field, mixed, variable, version3
from chanspark.sources.writer import block, write_file


def rows(path, number=0, names=None):
    """A table's columns as lists, read without Spark."""
    meta = read_meta(path)
    table = meta.tables()[number]
    chosen = [c for _, c in table.columns() if names is None or c.name in names]
    schema = pa.schema([pa.field(ROW, pa.int64()), *(pa.field(c.name, arrow_type(c)) for c in chosen)])
    part = RowRange(path, meta.version, table, [c.name for c in chosen], 0, table.rows, 0)
    return pa.Table.from_batches(list(read_rows(part, schema)), schema).to_pydict()


def one_group(path, fields, records, size, inval=0, kind=b"DT", compression=None, **group):
    with open(path, "w+b") as f:
        w = Builder(f, "rows", compression)
        n = group.pop("rows", len(records) // (size + inval) if size + inval else 0)
        data = w.data(kind, records, size) if records else 0
        w.seal(w.data_group(w.group(fields, n, size, inval, **group), data))
    return str(path)


def test_integers_of_all_widths():
    for bits in range(1, 65):
        for offset in (0, 1, 3, 7):
            width = (bits + offset + 7) // 8
            if width > 8:
                continue
            for signed in (False, True):
                low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
                values = sorted({low, high, 0, low // 3, high // 2, min(high, 1)})
                for big in (False, True):
                    raw = [((v % (1 << bits)) << offset | (1 << offset) - 1).to_bytes(width, "big" if big else "little") for v in values]
                    c = Channel("c", data_type=(2 if signed else 0) + big, bit_offset=offset, bit_count=bits, big_endian=big)
                    got = integers(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width), c)
                    assert [int(x) for x in got] == values, (bits, offset, signed, big)


def test_strings_and_bytes(tmp_path):
    words = "zero one two three four five six seven eight nine".split()
    record = b"".join(w.encode("cp1252").ljust(6, b"\0") + w.encode().ljust(6, b"\0") + w.encode("utf-16-le").ljust(12, b"\0") + w.encode("utf-16-be").ljust(12, b"\0") + bytes(range(k, k + 5)) for k, w in enumerate(words))
    fields = [Field("sbc", 6, 48, 0), Field("utf8", 7, 48, 6), Field("le", 8, 96, 12), Field("be", 9, 96, 24), Field("bytes", 10, 40, 36), Field("most", 7, 48, 6, kind=5)]
    got = rows(one_group(tmp_path / "a.mf4", fields, record, 41))
    assert all(got[k] == words for k in ("sbc", "utf8", "le", "be", "most")) and got["bytes"][3] == bytes(range(3, 8))


def test_invalid_bits(tmp_path):
    records = b"".join(struct.pack("<hB", k, 0b11 * (k % 2) | 0b100 * (k == 4)) for k in range(6))
    fields = [Field("a", 2, 16, 0, flags=2, inval_bit=1), Field("b", 2, 16, 0, flags=2, inval_bit=2), Field("c", 2, 16, 0), Field("d", 2, 16, 0, flags=1)]
    got = rows(one_group(tmp_path / "a.mf4", fields, records, 2, 1))
    assert got["a"] == [0, None, 2, None, 4, None] and got["b"] == [0, 1, 2, 3, None, 5] and got["c"] == list(range(6)) and got["d"] == [None] * 6


def test_arrays(tmp_path):
    cells = np.arange(24, dtype="<f4").reshape(2, 12)
    fields = [Field("row", 4, 32, 0, shape=(3, 4)), Field("column", 4, 32, 0, shape=(3, 4), column_major=True), Field("flat", 4, 32, 0, shape=(12,))]
    got = rows(one_group(tmp_path / "a.mf4", fields, cells.tobytes(), 48))
    assert got["row"] == cells.reshape(2, 3, 4).tolist() and got["flat"] == cells.tolist()
    assert got["column"] == [c.reshape(3, 4, order="F").tolist() for c in cells]


def test_structures_and_canopen(tmp_path):
    fields = [Field("s", 0, 0, members=[Field("x", 2, 16, 0), Field("y", 2, 16, 2)]), Field("when", 13, 56, 4), Field("clock", 14, 48, 11)]
    record = struct.pack("<hhHBBBBBIH", -1, 7, 59_999, 33, 21, 15, 11, 99, 86_399_999, 14_000)
    got = rows(one_group(tmp_path / "a.mf4", fields, record, 17))
    assert {k: v[0] for k, v in got.items() if k != ROW} == {"x": -1, "y": 7, "when ms": 59_999, "when min": 33, "when hour": 21, "when day": 15, "when month": 11, "when year": 99, "clock ms": 86_399_999, "clock days": 14_000}


def test_names_are_made_unique(tmp_path):
    fields = [Field("ID", 2, 16, 0, source=("CAN", "bus 1")), Field("id", 2, 16, 0, source=("CAN", "bus 1")), Field("ID", 2, 16, 0, source=("CAN", "bus 1")), Field("ID", 2, 16, 0), Field("ID", 2, 16, 0)]
    meta = read_meta(one_group(tmp_path / "a.mf4", fields, b"\1\0" * 3, 2, name="group"))
    names = [c.name for _, c in meta.tables()[0].columns()]
    assert names[:4] == ["ID", "id CAN", "ID CAN bus 1", "ID group"] and len({n.lower() for n in names}) == 5


def test_variable_length_and_unsorted(tmp_path):
    words = ["", "one", "zwei", "trois" * 100, "ü"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(words)], names=["key", "value"])
    for in_group in (False, True):
        path = str(tmp_path / f"{in_group}.mf4")
        variable(iter([batch]), path, in_group)
        assert rows(path)["value"] == words and rows(path, names=["key"])["key"] == list(range(5))
    tags = pa.RecordBatch.from_arrays([pa.array([k % 3 // 2 for k in range(9000)]), pa.array(range(9000)), pa.array(np.arange(9000) / 2)], names=["tag", "key", "value"])
    for id_size in (1, 2, 4, 8):
        path = str(tmp_path / f"m{id_size}.mf4")
        mixed(iter([tags]), path, id_size, "deflate" if id_size == 4 else None)
        assert rows(path, 0)["key_a"] == [k for k in range(9000) if k % 3 < 2] and rows(path, 1)["key_b"] == [k for k in range(9000) if k % 3 == 2]


def test_faults(tmp_path):
    good = one_group(tmp_path / "a.mf4", [Field("a", 2, 64, 0)], b"\1" * 8000, 8, compression="deflate")
    data = bytearray(open(good, "rb").read())
    at = data.index(b"##DZ")
    for change in (lambda d: d.__setitem__(at + 50, d[at + 50] ^ 255), lambda d: d.__delitem__(slice(len(d) - 40, None)), lambda d: d.__setitem__(slice(at, at + 4), b"##XX")):
        bad = bytearray(data)
        change(bad)
        (tmp_path / "bad.mf4").write_bytes(bad)
        with pytest.raises((ValueError, zlib.error, struct.error)):
            rows(str(tmp_path / "bad.mf4"))
    (tmp_path / "no.mf4").write_bytes(b"not a measurement file" * 10)
    with pytest.raises(ValueError, match="no measurement file"):
        read_meta(str(tmp_path / "no.mf4"))
    with pytest.raises(ValueError, match="end"):
        rows(one_group(tmp_path / "short.mf4", [Field("a", 2, 64, 0)], b"\1" * 80, 8, rows=11))


def test_empty_files(tmp_path):
    with open(tmp_path / "e.mf4", "w+b") as f:
        Builder(f).seal(0)
    assert read_meta(str(tmp_path / "e.mf4")).tables() == []
    assert rows(one_group(tmp_path / "z.mf4", [Field("a", 2, 64, 0)], b"", 8, rows=0))["a"] == []


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 7), st.lists(st.integers(1, 50), min_size=1, max_size=8), st.data())
def test_streams_read_any_stretch(data, param, cuts, draw):
    """Plain, compressed and transposed segments are one stream of bytes."""
    import io

    f, segments, at, k = io.BytesIO(), [], 0, 0
    while at < len(data):
        part = data[at : at + cuts[k % len(cuts)]]
        if k % 3 == 0:
            segments.append(Segment(f.tell(), len(part)))
            f.write(part)
        else:
            m = len(part) // param
            body = np.frombuffer(part, np.uint8, m * param).reshape(m, param).T.tobytes() + part[m * param :] if k % 3 == 2 else part
            packed = zlib.compress(body)
            segments.append(Segment(f.tell(), len(part), len(packed), 1 if k % 3 == 2 else 0, param))
            f.write(packed)
        at, k = at + len(part), k + 1
    a = draw.draw(st.integers(0, len(data)))
    b = draw.draw(st.integers(a, len(data)))
    assert Stream(f, segments).read(a, b) == data[a:b]


SCHEMA = T.StructType([T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType())])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.none() | st.floats(allow_nan=False), st.none() | st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=9), st.none() | st.binary(min_size=3, max_size=3)), max_size=20), st.sampled_from([("columns", None), ("columns", "deflate"), ("rows", None), ("rows", "deflate"), ("rows", "transpose")]))
def test_what_is_written_is_read(tmp_path_factory, values, how):
    path = str(tmp_path_factory.mktemp("w") / "a.mf4")
    columns = list(zip(*values, strict=True)) or [[], [], [], []]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.string(), pa.binary()), strict=True)], names=list("idsb"))
    assert write_file(path, iter([batch] if values else []), SCHEMA, *how) == len(values)
    got = rows(path)
    assert got["i"] == list(columns[0]) and got["d"] == list(columns[1]) and got["s"] == list(columns[2])
    assert got["b"] == [x if x is None or any(v[3] for v in values) is False else x for x in columns[3]]


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("version", [300, 320, 330])
def test_version3(tmp_path, version, big):
    e = ">" if big else "<"
    n = 20
    records = b"".join(struct.pack(e + "dHf8s", k / 2, k << 4, k * 1.5, f"t{k}".encode()) for k in range(n))
    text = lambda t: t.encode().ljust(32, b"\0")
    channels = [
        {"name": "time", "type": 3, "byte": 0, "bits": 64, "master": True}, {"name": "field", "type": 0, "byte": 8, "bit": 4, "bits": 8, "unit": "V", "description": "a field", "cc": (0, 2, struct.pack(e + "dd", 1, 2))} if not big else {"name": "field", "type": 0, "byte": 8, "bit": 4, "bits": 12},
        {"name": "f", "type": 2, "byte": 10, "bits": 32}, {"name": "text", "type": 7, "byte": 14, "bits": 64}, {"name": "a name of more than thirty-one characters", "type": 2, "byte": 10, "bits": 32, "cc": (12, 2, [(0.0, 0.0, "other"), (3.0, 6.0, "some")])},
        {"name": "gear", "type": 0, "byte": 8, "bit": 4 if not big else 4, "bits": 8 if not big else 12, "cc": (11, 2, struct.pack(e + "d", 1) + text("one") + struct.pack(e + "d", 2) + text("two"))},
        {"name": "field", "type": 0, "byte": 8, "bits": 16, "ce": (19, struct.pack(e + "II", 1, 2) + b"Frame".ljust(36, b"\0") + b"Sender".ljust(36, b"\0"))},
    ]
    path = str(tmp_path / "a.dat")
    version3(path, records, n, 22, channels, version, big)
    meta, got = read_meta(path), rows(path)
    assert meta.version == version and meta.start_ns == 1_044_072_306 * 10**9 and meta.comments["author"] == "An Author"
    assert got["time"] == [k / 2 for k in range(n)] and got["field"] == list(range(n)) and got["f"] == [k * 1.5 for k in range(n)] and got["text"] == [f"t{k}" for k in range(n)]
    assert "field Frame" in got and got["field Frame"] == [k << 4 for k in range(n)] and "a name of more than thirty-one characters" in got


def test_version3_unsorted(tmp_path):
    parts, n = [], 30
    for k in range(n):
        parts.append(struct.pack("<Bi", 1, k) + b"\1" if k % 2 else struct.pack("<Bq", 2, k) + b"\2")
    groups = [{"record_id": 1, "rows": n // 2, "size": 4, "channels": [{"name": "a", "type": 1, "byte": 0, "bits": 32}]}, {"record_id": 2, "rows": n // 2, "size": 8, "channels": [{"name": "b", "type": 1, "byte": 0, "bits": 64}]}]
    version3(str(tmp_path / "u.dat"), b"".join(parts), 0, 0, [], groups=groups, n_ids=2)
    assert rows(str(tmp_path / "u.dat"), 0)["a"] == list(range(1, n, 2)) and rows(str(tmp_path / "u.dat"), 1)["b"] == list(range(0, n, 2))


def test_attachments_events_history(spark, tmp_path):
    path = str(tmp_path / "a.mf4")
    with open(path, "w+b") as f:
        w = Builder(f, comments={"Author": "me", "comment": "a & b"}, start_ns=10**18)
        at = 0
        for data, flags, md5 in ((b"plain", 5, hashlib.md5(b"plain").digest()), (b"packed" * 9, 7, b"x" * 16)):
            stored = zlib.compress(data) if flags & 2 else data
            at = w.put(block(b"AT", [at, w.text("file.txt"), w.text("text/plain"), 0], struct.pack("<HH4x16sQQ", flags, 0, md5, len(data), len(stored)) + stored))
        ev = w.put(block(b"EV", [0, 0, 0, w.text("start"), 0], struct.pack("<5B3xIHHqd", 6, 1, 0, 1, 0, 0, 0, 0, 25, 0.1)))
        w.seal(0)
        f.seek(64)
        head = bytearray(f.read(104))
        struct.pack_into("<qq", head, 24 + 24, at, ev)
        f.seek(64)
        f.write(head)
    file = mdf.MdfFile(spark, path)
    assert [(r.name, r.data, r.intact) for r in file.attachments().collect()] == [("file.txt", b"packed" * 9, False), ("file.txt", b"plain", True)]
    assert [(r.name, r.type, r.value) for r in file.events().collect()] == [("start", 6, 2.5)]
    h = file.header().first()
    assert h.comments == {"Author": "me", "comment": "a & b"} and h.start_ns == 10**18 and h.version == 420
    assert file.file_history().first().tags == {"tool_id": "chanspark"}


def test_facade(spark, tmp_path):
    path = one_group(tmp_path / "a.mf4", [Field("t", 0, 0, kind=3, sync=1, unit="s", conversion=Conversion(4, 1, [0, 0.03])), Field("speed (km/h).x", 2, 16, 0, unit="", description="how fast", conversion=Conversion(4, 1, [0.0, 2.0], unit="km/h"))], struct.pack("<101h", *range(101)), 2)
    file = mdf.MdfFile(spark, path)
    name = "speed (km/h).x"
    assert file.unit(name) == "km/h" and file.description(name) == "how fast" and file.master(name) == "t" and file.master_type(name) == 1 and file.dtype(name) == T.DoubleType()
    assert file.masters() == {"t": [name, "t"]} and file.channel_names() == [name, "t"]
    got = file.table(0, rows=True).orderBy("_row").collect()
    assert [r["t"] for r in got] == [k * 0.03 for k in range(101)] and [r[name] for r in got] == [2.0 * k for k in range(101)]
    assert file.select(name, raw=True).dtypes == [(name, "smallint")] and file.group(name).schema[name].metadata["unit"] == "km/h"
    split = spark.read.format("mdf").option("partitionBytes", 20).load(path)
    assert split.rdd.getNumPartitions() > 5 and sorted(r["_row"] for r in split.collect()) == list(range(101))
    assert file.describe().where("name = 't'").first().first == "0.0"
    with pytest.raises(KeyError):
        file.unit("nothing")
    copy = file.write(str(tmp_path / "copy.mf4"), compression=True)
    assert copy.unit(name) == "km/h" and copy.master(name) == "t" and sorted(copy.table(0).collect()) == sorted(file.table(0).collect())
    main([path, "-w", str(tmp_path / "cli.mf4"), "-z", "-p", str(tmp_path / "parquet"), "--parquet_compression", "snappy", "-i"])
    assert spark.read.parquet(str(tmp_path / "parquet/a_0_t.parquet")).schema[name].metadata["unit"] == "km/h"
    with pytest.raises(ImportError):
        file.export_hdf5(str(tmp_path / "x.h5"))
    with pytest.raises(KeyError):
        file.export_parquet(str(tmp_path), "nonsense")


def test_edits(spark):
    df = mdf.set_master(spark.createDataFrame([(1, 2.0)], "t int, v double"), "t")
    df = mdf.set_description(mdf.set_unit(df, "v", "Bar"), "v", "tralala")
    df = mdf.rename_channel(mdf.add_channel(df, "w", F.lit(0.0), "A"), "t", "time")
    assert df.schema["v"].metadata == {"master": "time", "unit": "Bar", "description": "tralala"} and df.schema["w"].metadata["master"] == "time"
    assert mdf.remove_channel(df, "w").columns == ["time", "v"] and mdf.set_data(df, "v", F.lit(5.0)).schema["v"].metadata["unit"] == "Bar"
    with pytest.raises(ValueError):
        mdf.add_channel(df, "v", F.lit(1))


def test_written_types(spark, tmp_path):
    df = spark.sql("select cast(k as tinyint) a, cast(k as smallint) b, k % 2 = 0 c, cast(k as float) d, named_struct('re', cast(k as double), 'im', cast(-k as double)) e, array(array(k, k + 1), array(k + 2, k + 3)) f, cast(k as decimal(20,0)) g, timestamp_micros(k) h, date_from_unix_date(cast(k as int)) i from (select cast(id as int) k from range(5))")
    for layout in ("columns", "rows"):
        path = str(tmp_path / f"{layout}.mf4")
        mdf.save(df, path, layout)
        want = df.selectExpr("a", "b", "cast(c as tinyint) c", "d", "e", "f", "g", "unix_micros(h) * 1000 h", "unix_date(i) i").collect()
        assert sorted(map(str, mdf.MdfFile(spark, path).table(0).collect())) == sorted(map(str, want))
    with pytest.raises(TypeError):
        mdf.save(spark.sql("select map(1, 2) m"), str(tmp_path / "m.mf4"))


def test_folders_and_streams(spark, tmp_path):
    mdf.register(spark)
    folder = str(tmp_path / "folder")
    spark.range(100).repartition(3).write.format("mdf").mode("append").save(folder)
    stream = spark.readStream.format("mdf").load(folder)
    q = stream.writeStream.format("memory").queryName("mdf_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("mdf_rows").count() == 100
        spark.range(100, 150).coalesce(1).write.format("mdf").mode("append").save(folder)
        q.processAllAvailable()
        assert sorted(r.id for r in spark.table("mdf_rows").collect()) == list(range(150))
    finally:
        q.stop()
    df = spark.read.format("mdf").option("channels", json.dumps(["id"])).load(folder)
    assert sorted(r["_row"] for r in df.collect()) == list(range(150))
    spark.range(7).coalesce(1).write.format("mdf").mode("overwrite").save(folder)
    assert spark.read.format("mdf").load(folder).count() == 7


def test_pushed_filters_read_fewer_rows(spark, tmp_path):
    """Bounds of the master and of the row number: as many rows as without push-down, from fewer partitions."""
    n = 40_000
    for layout, how in (("rows", False), ("rows", True), ("columns", False), ("columns", True)):
        path = str(tmp_path / f"{layout}-{how}.mf4")
        df = spark.range(n).select((F.col("id") * 0.25).alias("time"), F.col("id").alias("value"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("some"))
        mdf.save(mdf.set_master(df.coalesce(1), "time"), path, layout, how)
        load = lambda **o: spark.read.format("mdf").option("path", path).option("partitionBytes", 20_000).options(**o).load()  # noqa: E731, B023
        everything = load()
        whole = everything.rdd.getNumPartitions()
        assert whole > 20 and everything.count() == n
        for where, want in (("time >= 5000 and time < 5010", 40), ("time = 77.25", 1), ("time > 9999.5", 1), ("time < -1", 0), ("time > 1e9", 0), ("time <= 0", 1), ("_row >= 39990", 10), ("_row < 7 and time > 1", 2), ("_row = 5", 1)):
            some = load().where(where)
            assert some.count() == want, (layout, how, where)
            assert some.rdd.getNumPartitions() <= 2 < load(masterSorted="false").where("time >= 5000 and time < 5010").rdd.getNumPartitions()
        got = load().where("time between 1000 and 2000 and value % 2 = 0").orderBy("_row").collect()
        assert [(r._row, r.time, r.value, r.some) for r in got] == [(k, k * 0.25, k, k if k % 3 == 0 else None) for k in range(4000, 8001, 2)]


def test_window_by_physical_master(spark, tmp_path):
    path = str(tmp_path / "w.mf4")
    records = b"".join(struct.pack("<iq", k, k * k) for k in range(5000))
    fields = [Field("t", 2, 32, 0, kind=2, sync=1, conversion=Conversion(4, 1, [10.0, 0.1])), Field("v", 2, 64, 4)]
    one_group(path, fields, records, 12)
    f = mdf.MdfFile(spark, path)
    for low, high in ((50.0, 60.0), (None, 10.3), (509.7, None), (-5.0, 5.0), (10.1, 10.1), (1e300, None), (None, -1e300)):
        want = [k * k for k in range(5000) if (low is None or k * 0.1 + 10.0 >= low) and (high is None or k * 0.1 + 10.0 <= high)]
        assert sorted(r.v for r in f.window("v", low, high).collect()) == want
    raw = spark.read.format("mdf").option("path", path).option("partitionBytes", 1200).load()
    assert raw.where("t >= 400 and t <= 500").rdd.getNumPartitions() <= 2


def test_ranges_carry_their_own_segments(tmp_path):
    """All row ranges together are about as large as the metadata, not as their square."""
    import pickle

    from chanspark.plans.partitions import row_ranges
    from chanspark.sources.model import Group, Table

    def total(n):
        g = Group(0, 0, n * 100, data_bytes=8, stream=[Segment(64 + k * 824, 800) for k in range(n)], channels=[Channel("a", data_type=2, bit_count=64)])
        ranges = list(row_ranges("x", 410, Table(0, [g]), ["a"], 0, 800 * 10))
        assert len(ranges) == n // 10 and all(len(r.table.groups[0].stream) == 10 and r.table.groups[0].stream_base == 800 * 10 * k for k, r in enumerate(ranges))
        return sum(len(pickle.dumps(r)) for r in ranges)

    assert total(4000) < 4.5 * total(1000)


@pytest.mark.parametrize("layout", ["rows", "columns"])
def test_several_tables_in_one_file(spark, tmp_path, layout):
    """Tables of other lengths and masters come back each; a table of an attempt that failed leaves nothing."""
    path = str(tmp_path / "many.mf4")
    a = mdf.set_master(spark.range(1000).select(F.col("id").alias("ta"), (F.col("id") * 2).alias("x")), "ta")
    b = mdf.set_master(spark.range(37).select((F.col("id") / 4).alias("tb"), F.concat(F.lit("t"), "id").alias("text")), "tb")
    c = spark.range(0).select(F.col("id").alias("none"))
    mdf.write_tables([a, b, c], path, layout=layout, comments={"comment": "three"})
    size = len(open(path, "rb").read())
    f = mdf.MdfFile(spark, path)
    assert f.channel_names() == ["none", "ta", "tb", "text", "x"] and f.master("x") == "ta" and f.master("text") == "tb" and f.meta.comments["comment"] == "three"
    assert sorted(map(tuple, f.group("x").collect())) == [(k, 2 * k) for k in range(1000)]
    assert sorted((r.tb, r.text) for r in f.group("text").collect()) == [(k / 4, f"t{k}") for k in range(37)]
    assert f.group("none").count() == 0
    mdf.save(a.withColumnRenamed("x", "left"), path, layout, append=True)
    with open(path, "r+b") as g:
        g.truncate(size + 100)  # as if that attempt had ended in its middle
    write_file(path, iter(b.withColumnRenamed("text", "again").toArrow().to_batches()), b.withColumnRenamed("text", "again").schema, layout, after=size)
    names = mdf.MdfFile(spark, path).channel_names()
    assert {"again", "none", "ta", "tb", "text", "x"} < set(names) and len(names) == 7 and "left" not in names
    assert mdf.MdfFile(spark, path).group("again").count() == 37
    copy = f.write(str(tmp_path / "copy.mf4"))
    assert [t.count() for t in copy.tables()] == [1000, 37, 0] and not list(tmp_path.glob("*.part"))


class FakeH5:
    """As much of h5py as the export uses."""

    class Set:
        def __init__(self, shape, dtype):
            self.data, self.attrs = np.zeros(shape, object if dtype == "text" else dtype), {}

        def resize(self, n, axis):
            self.data = np.concatenate([self.data, np.zeros((n - len(self.data), *self.data.shape[1:]), self.data.dtype)])

        def __len__(self):
            return len(self.data)

        def __setitem__(self, at, values):
            self.data[at] = values

    class File(dict):
        def __init__(self, path, mode):
            FakeH5.last = self

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def create_group(self, name):
            self[name] = FakeH5.File("", "")
            FakeH5.last = self
            return self[name]

        def create_dataset(self, name, shape, maxshape, chunks, dtype, compression):
            self[name] = FakeH5.Set(shape, dtype)
            return self[name]

    @staticmethod
    def string_dtype():
        return "text"


def test_hdf5_export(spark, tmp_path, monkeypatch):
    """Numbers, texts, arrays and nulls, over several partitions and batches."""
    import sys

    monkeypatch.setitem(sys.modules, "h5py", FakeH5)
    path = str(tmp_path / "h.mf4")
    df = spark.range(3000).select(F.col("id").alias("t"), F.when(F.col("id") > 2500, F.col("id") / 2).alias("half"), F.concat(F.lit("t"), "id").alias("text"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("pair"))
    mdf.save(mdf.set_unit(mdf.set_master(df.coalesce(1), "t"), "half", "km"), path, "rows")
    mdf.MdfFile(spark, path).export_hdf5(str(tmp_path / "x.h5"))
    g = FakeH5.last["0_t"]
    order = np.argsort(g["t"].data)
    assert (g["t"].data[order] == np.arange(3000)).all() and (g["text"].data[order] == [f"t{k}" for k in range(3000)]).all()
    assert (g["pair"].data[order][:, 0] == np.arange(3000)).all() and g["pair"].data.shape == (3000, 2)
    half, null = g["half"].data[order], g["half_null"].data[order]
    assert (null == (np.arange(3000) <= 2500)).all() and (half[~null] == np.arange(2501, 3000) / 2).all() and np.isnan(half[null]).all()
    assert g["half"].attrs["unit"] == "km" and "t_null" not in g
    bad = str(tmp_path / "z.mf4")
    mdf.save(spark.range(2).select(F.struct(F.lit(1.0).alias("re"), F.lit(2.0).alias("im")).alias("z")), bad)
    with pytest.raises(TypeError):
        mdf.MdfFile(spark, bad).export_hdf5(str(tmp_path / "y.h5"))


def test_parquet_metadata(spark, tmp_path):
    path = str(tmp_path / "p.mf4")
    mdf.save(mdf.set_unit(mdf.set_master(spark.range(5).select(F.col("id").alias("t"), F.col("id").alias("v")), "t"), "v", "V"), path)
    (out,) = mdf.MdfFile(spark, path).export_parquet(str(tmp_path))
    meta = spark.read.parquet(out).schema["v"].metadata
    assert (meta["unit"], meta["file_name"], meta["master_channel"]) == ("V", "p.mf4", "t")


def test_thinned(spark, tmp_path):
    path = str(tmp_path / "t.mf4")
    mdf.save(mdf.set_master(spark.range(10_000).coalesce(1).select((F.col("id") * 0.5).alias("t"), F.when(F.col("id") == 5555, 1e9).otherwise(F.col("id") % 7).alias("v")), "t"), path)
    f = mdf.MdfFile(spark, path)
    some = [(r.t, r.v) for r in f.thinned("v", 100).collect()]
    assert len(some) == 200 and some == sorted(some) and (5555 * 0.5, 1e9) in some and min(v for _, v in some) == 0
    assert f.thinned("v", 5000).count() == 10_000


def test_edits_of_names_with_dots(spark):
    df = mdf.set_master(spark.range(3).select(F.col("id").alias("a.b"), F.col("id").alias("c`d")), "a.b")
    df = mdf.rename_channel(mdf.set_data(mdf.add_channel(df, "x.y", F.lit(1), "V"), "c`d", F.lit(2)), "a.b", "e.f")
    assert df.columns == ["e.f", "c`d", "x.y"] and [tuple(r) for r in df.collect()] == [(k, 2, 1) for k in range(3)]
    assert {f.name: f.metadata["master"] for f in df.schema} == dict.fromkeys(df.columns, "e.f") and df.schema["e.f"].metadata["sync_type"] == 1


def test_many_files_by_threads(spark, tmp_path):
    from chanspark.sources.read import read_metas

    paths = []
    for k in range(40):
        paths.append(one_group(tmp_path / f"{k:03d}.mf4", [Field("a", 2, 64, 0)], struct.pack("<q", k) * (k + 1), 8))
    assert [m.path for m in read_metas(paths)] == paths and list(read_metas([])) == []
    mdf.register(spark)
    got = spark.read.format("mdf").load(str(tmp_path))
    assert sorted((r._row, r.a) for r in got.collect()) == list(enumerate(k for k in range(40) for _ in range(k + 1)))
    assert [r.a for r in got.where("_row >= 819").collect()] == [39]
