"""The registered queries of the measurement engine and, where SQL can express them, their DuckDB counterparts.

The tables hold no measurement files, so a scan query first writes one from a whole table and then reads it.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mdf
from .functions.conversion import to_physical
from .operators import tables as ops
from .session import shared_dir
from .sources import samples
from .sources.files import local
from .sources.model import Conversion
from .sources.samples import Field

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession, name: str = "file.mf4") -> str:
    """A new file in the folder that driver and executors share."""
    folder = local(shared_dir(spark))
    if folder is None:
        raise ValueError("these queries need a mounted shared folder")
    os.makedirs(folder)
    return f"{folder}/{name}"


_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
_LINE_SQL = f"SELECT {', '.join(_LINE)} FROM lineitem"


def _saved(spark: SparkSession, sf_dir: str, layout: str, compression: bool | str = False, columns: list[str] = _LINE) -> DataFrame:
    path = place(spark)
    mdf.save(table(spark, sf_dir, "lineitem").select(columns), path, layout, compression)
    return mdf.MdfFile(spark, path).table(0)


_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
for _name, _layout, _how in (("roundtrip_mdf4", "columns", False), ("roundtrip_mdf4_compressed", "columns", True)):
    query(_name, f"SELECT {', '.join(_ALL)} FROM lineitem")(partial(_saved, layout=_layout, compression=_how, columns=_ALL))
for _name, _layout, _how in (("scan_ld_dv", "columns", False), ("scan_hl", "rows", True), ("scan_dz_transposed", "rows", "transpose"), ("scan_sorted_rows", "rows", False)):
    query(_name, _LINE_SQL)(partial(_saved, layout=_layout, compression=_how))

_LINE_FIELDS = [Field("l_orderkey", 2, 64, 0), Field("l_linenumber", 2, 32, 8), Field("l_quantity", 4, 64, 12), Field("l_extendedprice", 4, 64, 20)]


def _built(spark: SparkSession, sf_dir: str, header: bool = False, compression: str | None = None, listed: bool = True) -> DataFrame:
    path = place(spark)
    samples.straddling(table(spark, sf_dir, "lineitem").select(_LINE), path, ["<i8", "<i4", "<f8", "<f8"], _LINE_FIELDS, header, compression, listed=listed)
    return mdf.MdfFile(spark, path).table(0)


query("scan_sorted_dt", _LINE_SQL)(partial(_built, listed=False))
query("scan_dz", _LINE_SQL)(partial(_built, listed=False, compression="deflate"))
query("scan_dl", _LINE_SQL)(_built)
query("scan_hl_dz", _LINE_SQL)(partial(_built, header=True, compression="deflate"))


@query("scan_dv", "SELECT n_nationkey, n_regionkey FROM nation")
def scan_dv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)

    def make(batches, path):
        with open(path, "w+b") as f:
            w = samples.Builder(f)
            rows = [samples.packed(b, ["<i4", "<i4"]) for b in batches]
            n = sum(map(len, rows))
            first = w.group([Field("n_nationkey", 2, 32)], n, 4)
            second = w.group([Field("n_regionkey", 2, 32)], n, 4, flags=8, extra=(first,))
            parts = [w.data(b"DV", b"".join(r[:, k : k + 4].tobytes() for r in rows), 4) for k in (0, 4)]
            w.seal(w.data_group(first, parts[0], following=w.data_group(second, parts[1])))

    samples.build(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), path, make)
    return mdf.MdfFile(spark, path).table(0)


@query("scan_projected", "SELECT l_linenumber, l_quantity FROM lineitem")
def scan_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    mdf.save(table(spark, sf_dir, "lineitem").select(_LINE), path)
    return mdf.MdfFile(spark, path).select("l_linenumber", "l_quantity")


@query("scan_folder", _LINE_SQL)
def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    mdf.register(spark)
    path = place(spark, "folder")
    table(spark, sf_dir, "lineitem").select(_LINE).repartition(4).write.format("mdf").mode("overwrite").option("layout", "rows").save(path)
    return spark.read.format("mdf").load(path).drop("_row")


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.lit(0).alias("tag"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    b = table(spark, sf_dir, "events").select(F.lit(1).alias("tag"), F.col("event_id").alias("key"), "value")
    return a.union(b)


@query("scan_unsorted", "SELECT 0 AS tag, o_orderkey AS key, o_totalprice AS value, CAST(NULL AS INTEGER) AS rest FROM orders UNION ALL SELECT 1, event_id, value, CAST(event_id % 7 AS INTEGER) FROM events")
def scan_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    samples.mixture(_two(spark, sf_dir).repartition(F.xxhash64("key")).sortWithinPartitions(F.xxhash64("tag", "key")), path)
    file = mdf.MdfFile(spark, path)
    a, b = file.group("key_a"), file.group("key_b")
    return a.select(F.lit(0).alias("tag"), F.col("key_a").alias("key"), F.col("value_a").alias("value"), F.lit(None).cast("int").alias("rest")).union(b.select(F.lit(1), "key_b", "value_b", "rest_b"))


def _variable(spark: SparkSession, sf_dir: str, in_group: bool) -> DataFrame:
    path = place(spark)
    samples.variables(table(spark, sf_dir, "events").select("event_id", "event_type"), path, in_group)
    return mdf.MdfFile(spark, path).group("key").select(F.col("key").alias("event_id"), F.col("value").alias("event_type"))


query("scan_vlsd", "SELECT event_id, event_type FROM events")(partial(_variable, in_group=False))
query("scan_unsorted_vlsd", "SELECT event_id, event_type FROM events")(partial(_variable, in_group=True))


def _decoded(spark: SparkSession, sf_dir: str, source: str, columns: list[tuple[str, str]], fields: list[Field]) -> DataFrame:
    """Columns (expression, number format) of a table as records, read by the fields."""
    path = place(spark)
    df = table(spark, sf_dir, source).select(*[F.expr(e).alias(f"c{k}") for k, (e, _) in enumerate(columns)])
    samples.straddling(df, path, [k for _, k in columns], fields)
    return mdf.MdfFile(spark, path).table(0)


@query("decode_ints", "SELECT l_orderkey AS i64, l_orderkey AS i64_be, CAST(l_linenumber AS SMALLINT) AS i16_be, CAST(l_linenumber AS TINYINT) AS i8, CAST(-l_linenumber AS INTEGER) AS i24, CAST(l_partkey AS BIGINT) AS u32, CAST(l_orderkey AS DECIMAL(20,0)) AS u64 FROM lineitem")
def decode_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [("l_orderkey", "<i8"), ("l_orderkey", ">i8"), ("l_linenumber", ">i2"), ("l_linenumber", "<i1"), ("-l_linenumber", "<i4"), ("l_partkey", "<u4"), ("l_orderkey", ">u8")]
    fields = [Field("i64", 2, 64, 0), Field("i64_be", 3, 64, 8), Field("i16_be", 3, 16, 16), Field("i8", 2, 8, 18), Field("i24", 2, 24, 19), Field("u32", 0, 32, 23), Field("u64", 1, 64, 27)]
    return _decoded(spark, sf_dir, "lineitem", columns, fields)


@query("decode_floats", "SELECT l_quantity AS f64, l_quantity AS f64_be, CAST(l_quantity AS REAL) AS f32, CAST(l_quantity AS REAL) AS f32_be, CAST(l_quantity AS REAL) AS f16 FROM lineitem")
def decode_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [("l_quantity", k) for k in ("<f8", ">f8", "<f4", ">f4", "<f2")]
    fields = [Field("f64", 4, 64, 0), Field("f64_be", 5, 64, 8), Field("f32", 4, 32, 16), Field("f32_be", 5, 32, 20), Field("f16", 4, 16, 24)]
    return _decoded(spark, sf_dir, "lineitem", columns, fields)


@query("decode_complex", "SELECT event_id, value AS re, -value AS im FROM events")
def decode_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _decoded(spark, sf_dir, "events", [("event_id", "<i8"), ("value", "<f8"), ("-value", "<f8")], [Field("event_id", 2, 64, 0), Field("z", 15, 128, 8)])
    return df.select("event_id", "z.re", "z.im")


@query("bit_extract", "SELECT l_partkey, CAST((l_partkey // 4) % 8 AS SMALLINT) AS field, CAST(CASE WHEN (l_partkey // 4) % 8 > 3 THEN (l_partkey // 4) % 8 - 8 ELSE (l_partkey // 4) % 8 END AS TINYINT) AS field_signed, (l_partkey // 4) % 8 AS by_column FROM lineitem")
def bit_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _decoded(spark, sf_dir, "lineitem", [("l_partkey", "<i8")], [Field("l_partkey", 2, 64), Field("field", 0, 3, bit=2), Field("field_signed", 2, 3, bit=2)])
    return df.withColumn("by_column", ops.extract_bits(F.col("l_partkey"), 2, 3))


@query("virtual_channel", "SELECT r_regionkey, CAST(row_number() OVER () - 1 AS BIGINT) AS row_index, CAST(0.5 * (row_number() OVER () - 1) + 1 AS DOUBLE) AS linear FROM (SELECT * FROM region ORDER BY r_regionkey)")
def virtual_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    fields = [Field("r_regionkey", 2, 32), Field("row_index", 0, 0, kind=6), Field("linear", 0, 0, kind=3, sync=1, conversion=Conversion(4, 1, [1.0, 0.5]))]
    samples.straddling(table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey"), path, ["<i4"], fields)
    return mdf.MdfFile(spark, path).table(0)


@query("decode_strings", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def decode_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    mdf.save(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), path, "rows")
    return mdf.MdfFile(spark, path).table(0)


@query("decode_bytes", "SELECT p_partkey, hex(encode(p_brand)) AS brand_hex FROM part")
def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").cast("binary").alias("brand"))
    mdf.save(df, path)
    return mdf.MdfFile(spark, path).table(0).select("p_partkey", F.hex(F.expr("rtrim(X'00', brand)")).alias("brand_hex"))


@query("decode_arrays", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS cell FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def decode_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    mdf.save(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path, "rows")
    return mdf.MdfFile(spark, path).table(0).select("vec_id", F.posexplode("embedding").alias("pos", "cell"))


@query("validity_nulls", "SELECT event_id, CASE WHEN value >= 5 THEN value END AS value, CASE WHEN value >= 5 THEN event_type END AS event_type FROM events")
def validity_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    mdf.save(table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") >= 5, F.col("value")).alias("value"), F.when(F.col("value") >= 5, F.col("event_type")).alias("event_type")), path, "rows", True)
    return mdf.MdfFile(spark, path).table(0)


@query("remote_master_join", "SELECT event_id, user_id, value FROM events")
def remote_master_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that borrow a master are read beside it, row range by row range: the alignment needs no shuffle."""
    path = place(spark)
    mdf.save(mdf.set_master(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id"), path)
    return mdf.MdfFile(spark, path).group("value")


# Conversions

def _converted(spark: SparkSession, sf_dir: str, source: str, keys: list[str], raw: str, conversion: Conversion, digits: int | None = None) -> DataFrame:
    df = table(spark, sf_dir, source).select(*keys, F.expr(raw).alias("raw"))
    value: Column = to_physical(F.col("raw"), df.schema["raw"].dataType, conversion)[0]
    return df.select(*keys, (F.round(value, digits) if digits else value).alias("physical"))


def conversion_query(name: str, source: str, keys: list[str], raw: str, conversion: Conversion, sql: str, digits: int | None = None) -> None:
    value = f"round({sql}, {digits})" if digits else sql
    query(name, f"SELECT {', '.join(keys)}, {value} AS physical FROM {source}")(partial(_converted, source=source, keys=keys, raw=raw, conversion=conversion, digits=digits))


_L, _E = ["l_orderkey", "l_linenumber"], ["event_id"]
_POINTS = [(3.0, -5.0), (9.0, -2.0), (12.0, 0.0), (15.0, 1.0), (17.0, 2.0), (19.0, 0.0), (21.0, 3.0), (23.0, 6.0), (25.0, 3.0), (27.0, 0.0)]
_FLAT = [v for p in _POINTS for v in p]
_PAIRS = list(zip(_POINTS, _POINTS[1:], strict=False))
_CLAMP = "CASE WHEN value <= 3.0 THEN CAST(-5 AS DOUBLE) WHEN value >= 27.0 THEN CAST(0 AS DOUBLE) "
_INTERP = _CLAMP + " ".join(f"WHEN value = {a[0]} THEN {a[1]} WHEN value < {b[0]} THEN (CAST({a[1]} AS DOUBLE) * ({b[0]} - value) + CAST({b[1]} AS DOUBLE) * (value - {a[0]})) / CAST({b[0] - a[0]} AS DOUBLE)" for a, b in _PAIRS) + " END"
_NEAREST = _CLAMP + " ".join(f"WHEN value < {b[0]} THEN CASE WHEN value - CAST({a[0]} AS DOUBLE) > CAST({b[0]} AS DOUBLE) - value THEN {b[1]} ELSE {a[1]} END" for a, b in _PAIRS) + " END"
_RANGES = [(0.0, 3.0, 1.5), (3.0, 8.0, 2.5), (8.0, 20.0, -1.0), (20.0, 100.0, 7.0)]
_D = lambda x: f"CAST({x} AS DOUBLE)"

conversion_query("conv_identity", "lineitem", _L, "l_quantity", Conversion(4, 0), "l_quantity")
conversion_query("conv_linear", "lineitem", _L, "l_quantity", Conversion(4, 1, [-4.8, -3.2]), f"l_quantity * {_D(-3.2)} + {_D(-4.8)}")
conversion_query("conv_rational", "lineitem", _L, "l_quantity", Conversion(4, 2, [0.5, 2, 1, 0, 0.25, 3]), "(l_quantity * l_quantity * 0.5::DOUBLE + l_quantity * 2 + 1) / (l_quantity * l_quantity * 0 + l_quantity * 0.25::DOUBLE + 3)", 9)
conversion_query("conv_algebraic", "lineitem", _L, "l_quantity", Conversion(4, 3, formula="(X*X+1)/2 - max(X, 10) + 3*(X>20)"), "(l_quantity * l_quantity + 1) / 2 - greatest(l_quantity, 10) + CASE WHEN l_quantity > 20 THEN 3 ELSE 0 END", 9)
conversion_query("conv_v2v_interp", "events", _E, "value", Conversion(4, 4, _FLAT), _INTERP, 9)
conversion_query("conv_v2v_nearest", "events", _E, "value", Conversion(4, 5, _FLAT), f"CAST({_NEAREST} AS DOUBLE)")
conversion_query("conv_range2value", "events", _E, "value", Conversion(4, 6, [v for r in _RANGES for v in r] + [-9.0]), "CAST(CASE " + " ".join(f"WHEN value >= {a} AND value < {b} THEN {v}" for a, b, v in _RANGES) + " ELSE -9 END AS DOUBLE)")
conversion_query("conv_value2text", "lineitem", _L, "l_linenumber", Conversion(4, 7, [1, 2, 3], ["first gear", "second gear", Conversion(4, 1, [1.0, 2.0]), "no match"]), "CASE l_linenumber WHEN 1 THEN 'first gear' WHEN 2 THEN 'second gear' WHEN 3 THEN '7' ELSE 'no match' END")
conversion_query("conv_value2text_nil", "lineitem", _L, "l_linenumber", Conversion(4, 7, [1], ["one", None]), "CASE l_linenumber WHEN 1 THEN 'one' ELSE CAST(l_linenumber AS VARCHAR) END")
conversion_query("conv_range2text", "lineitem", _L, "l_linenumber", Conversion(4, 8, [1, 2, 3, 4, 5, 6], ["low", "medium", "high", "out of range"]), "CASE WHEN l_linenumber BETWEEN 1 AND 2 THEN 'low' WHEN l_linenumber BETWEEN 3 AND 4 THEN 'medium' WHEN l_linenumber BETWEEN 5 AND 6 THEN 'high' ELSE 'out of range' END")
conversion_query("conv_text2value", "events", _E, "event_type", Conversion(4, 9, [1.0, 2.0, -50.0], ["view", "click"]), "CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE -50 END AS DOUBLE)")
conversion_query("conv_text2text", "events", _E, "event_type", Conversion(4, 10, [], ["view", "Ansicht", "click", "Klick", None]), "CASE event_type WHEN 'view' THEN 'Ansicht' WHEN 'click' THEN 'Klick' ELSE event_type END")
conversion_query("conv_bitfield", "lineitem", _L, "l_linenumber", Conversion(4, 11, [1, 6], [Conversion(4, 7, [0, 1], ["even", "odd"], name="parity"), Conversion(4, 8, [0, 2, 4, 6], ["low", "high"])]), "' | parity = ' || CASE WHEN l_linenumber % 2 = 1 THEN 'odd' ELSE 'even' END || ' | ' || CASE WHEN l_linenumber & 6 <= 2 THEN 'low' ELSE 'high' END")
conversion_query("conv3_polynomial", "events", _E, "value", Conversion(3, 6, [1, 2, 3, 4, 0.5, 0.25]), f"({_D(2)} - 4 * (value - 0.5::DOUBLE - 0.25::DOUBLE)) / (3 * (value - 0.5::DOUBLE - 0.25::DOUBLE) - 1)", 9)
conversion_query("conv3_exponential", "events", _E, "value", Conversion(3, 7, [2, 0.5, -1, 0, 0, 3, -7]), "ln(((value + 7) * 3 + 1) / 2) / 0.5", 9)
conversion_query("conv3_logarithmic", "events", _E, "value", Conversion(3, 8, [200, 0.5, -1, 0, 0, 3, -7]), "exp(((value + 7) * 3 + 1) / 200) / 0.5", 6)
conversion_query("conv3_texttable", "lineitem", _L, "l_linenumber", Conversion(3, 11, [1, 2, 3], ["one", "two", "three"]), "CASE l_linenumber WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE 'one' END")
conversion_query("conv3_textrange", "events", _E, "value", Conversion(3, 12, [0, 0, 0, 5, 5, 50], ["other", "small", "medium"]), "CASE WHEN value >= 0 AND value < 5 THEN 'small' WHEN value >= 5 AND value < 50 THEN 'medium' ELSE 'other' END")


# With p4 = 0 the first form holds, with p1 = 0 the second.
conversion_query("conv3_exponential_second", "events", _E, "value", Conversion(3, 7, [0, 0, 50, 2, 0.5, -3, -7]), "ln((50 / (value + 7) + 3) / 2) / 0.5", 9)
conversion_query("conv3_logarithmic_second", "events", _E, "value", Conversion(3, 8, [0, 0, 50, 200, 0.5, -3, -7]), "exp((50 / (value + 7) + 3) / 200) / 0.5", 9)
conversion_query("conv3_interpolated", "events", _E, "value", Conversion(3, 1, _FLAT), _INTERP, 9)
conversion_query("conv3_tabular", "events", _E, "value", Conversion(3, 2, _FLAT), f"CAST({_NEAREST} AS DOUBLE)")
conversion_query("conv3_linear", "lineitem", _L, "l_quantity", Conversion(3, 0, [-4.8, -3.2]), f"l_quantity * {_D(-3.2)} + {_D(-4.8)}")
conversion_query("conv3_rational", "lineitem", _L, "l_quantity", Conversion(3, 9, [0.5, 2, 1, 0, 0.25, 3]), "(l_quantity * l_quantity * 0.5::DOUBLE + l_quantity * 2 + 1) / (l_quantity * l_quantity * 0 + l_quantity * 0.25::DOUBLE + 3)", 9)
conversion_query("conv3_formula", "lineitem", _L, "l_quantity", Conversion(3, 10, formula="(X1*X1+1)/2 - 3*X1"), "(l_quantity * l_quantity + 1) / 2 - 3 * l_quantity", 9)
conversion_query("conv3_identity", "lineitem", _L, "l_quantity", Conversion(3, 65535), "l_quantity")


_V3_CHANNELS = f"round({_INTERP}, 9) AS interpolated, CAST({_NEAREST} AS DOUBLE) AS tabular, round((value * value + 2) / (0.5::DOUBLE * value + 3), 9) AS rational, round(value * value / 2 - 1, 9) AS formula, round(ln((value + 1) / 2) / 0.5, 9) AS exponential"


@query("v3_conversions", f"SELECT event_id, {_V3_CHANNELS} FROM events")
def v3_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions as version 3 files store them, all of the same bytes."""
    path = place(spark, "file.mdf")
    doubles = lambda *v: samples.struct.pack(f"<{len(v)}d", *v)
    blocks = {"interpolated": (1, len(_POINTS), doubles(*_FLAT)), "tabular": (2, len(_POINTS), doubles(*_FLAT)), "rational": (9, 6, doubles(1, 0, 2, 0, 0.5, 3)), "formula": (10, 1, b"X1*X1/2-1".ljust(256, b"\0")), "exponential": (7, 7, doubles(2, 0.5, -1, 0, 0, 1, 0))}
    channels = [{"name": "event_id", "type": 1, "byte": 0, "bits": 64, "master": True}, *({"name": n, "type": 3, "byte": 8, "bits": 64, "cc": cc} for n, cc in blocks.items())]
    samples.version3_table(table(spark, sf_dir, "events").select("event_id", "value"), path, ["<i8", "<f8"], channels)
    return mdf.MdfFile(spark, path).table(0).select("event_id", *[c if c == "tabular" else F.round(c, 9).alias(c) for c in blocks])


_DATE_SQL = "CAST(event_id % 60000 AS INTEGER) AS ms, CAST(event_id % 60 AS SMALLINT) AS min, CAST(event_id % 24 AS SMALLINT) AS hour, CAST(event_id % 28 + 1 AS SMALLINT) AS day, CAST(event_id % 12 + 1 AS SMALLINT) AS month, CAST(event_id % 100 AS SMALLINT) AS year"
_DATE_BYTES = [("event_id", "<i8"), ("event_id % 60000", "<u2"), ("event_id % 60", "<u1"), ("event_id % 24", "<u1"), ("event_id % 28 + 1", "<u1"), ("event_id % 12 + 1", "<u1"), ("event_id % 100", "<u1"), ("event_id * 3", "<u4"), ("event_id % 20000", "<u2")]


def _dates(df: DataFrame) -> DataFrame:
    date = [F.col(f"`d {n}`").cast("int" if n == "ms" else "smallint").alias(n) for n in ("ms", "min", "hour", "day", "month", "year")]
    return df.select("event_id", *date, F.col("`t ms`").cast("bigint").alias("time_ms"), F.col("`t days`").cast("int").alias("time_days"))


@query("decode_canopen", f"SELECT event_id, {_DATE_SQL}, CAST(event_id * 3 AS BIGINT) AS time_ms, CAST(event_id % 20000 AS INTEGER) AS time_days FROM events")
def decode_canopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CANopen date and a CANopen time, as the channels of their parts."""
    return _dates(_decoded(spark, sf_dir, "events", _DATE_BYTES, [Field("event_id", 2, 64, 0), Field("d", 13, 56, 8), Field("t", 14, 48, 15)]))


@query("v3_canopen", f"SELECT event_id, {_DATE_SQL}, CAST(event_id * 3 AS BIGINT) AS time_ms, CAST(event_id % 20000 AS INTEGER) AS time_days FROM events")
def v3_canopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as conversions 132 and 133 of a version 3 file."""
    path = place(spark, "file.mdf")
    channels = [{"name": "event_id", "type": 1, "byte": 0, "bits": 64, "master": True}, {"name": "d", "type": 8, "byte": 8, "bits": 56, "cc": (132, 0, b"")}, {"name": "t", "type": 8, "byte": 15, "bits": 48, "cc": (133, 0, b"")}]
    samples.version3_table(table(spark, sf_dir, "events").select(*[F.expr(e).alias(f"c{k}") for k, (e, _) in enumerate(_DATE_BYTES)]), path, [k for _, k in _DATE_BYTES], channels)
    return _dates(mdf.MdfFile(spark, path).table(0))


@query("decode_matrices", "SELECT l_orderkey, l_linenumber, CAST(r.i AS INTEGER) AS i, CAST(c.j AS INTEGER) AS j, CASE r.i * 2 + c.j WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice WHEN 2 THEN l_discount ELSE l_tax END AS cell FROM lineitem, (VALUES (0), (1)) r(i), (VALUES (0), (1)) c(j)")
def decode_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional arrays, with values for their axes."""
    columns = [("l_orderkey", "<i8"), ("l_linenumber", "<i4"), ("l_quantity", "<f8"), ("l_extendedprice", "<f8"), ("l_discount", "<f8"), ("l_tax", "<f8")]
    df = _decoded(spark, sf_dir, "lineitem", columns, [Field("l_orderkey", 2, 64, 0), Field("l_linenumber", 2, 32, 8), Field("m", 4, 64, 12, shape=(2, 2), axes=((1.0, 2.0), (10.0, 20.0)))])
    return df.select("l_orderkey", "l_linenumber", F.posexplode("m").alias("i", "row")).select("l_orderkey", "l_linenumber", "i", F.posexplode("row").alias("j", "cell"))


@query("meta_arrays", "SELECT 'm' AS name, 'C' AS \"order\", 6 AS cells, '10.0,20.0,30.0' AS second_axis")
def meta_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    numbers = table(spark, sf_dir, "region").select(*[F.lit(float(k)).alias(f"c{k}") for k in range(6)])
    samples.straddling(numbers, path, ["<f8"] * 6, [Field("m", 4, 64, 0, shape=(2, 3), axes=((1.0, 2.0), (10.0, 20.0, 30.0)))])
    return mdf.MdfFile(spark, path).arrays().select("name", "order", F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x).cast("int").alias("cells"), F.array_join(F.get("axes", F.lit(1)).cast("array<string>"), ",").alias("second_axis"))


_START = 1_700_000_000_123_456_000


def _documents(spark: SparkSession, sf_dir: str) -> mdf.MdfFile:
    """A file whose attachments are the regions' names and whose events are the regions, with comments of its own."""
    path = place(spark)

    def make(batches, path):
        rows = [r for b in batches for r in b.to_pylist()]
        samples.documented(path, [(f"{r['r_name']}.txt", r["r_name"].encode() * 50, r["r_regionkey"] % 2 == 1) for r in rows], [(r["r_name"], 6, r["r_regionkey"] * 10, 0.5) for r in rows], {"Author": "An Author", "comment": "a & b", "project": "<none>"}, _START)

    samples.build(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path, make)
    return mdf.MdfFile(spark, path)


@query("meta_attachments", "SELECT r_name || '.txt' AS name, 'text/plain' AS mime, CAST(50 * length(r_name) AS BIGINT) AS size, md5(repeat(r_name, 50)) AS md5_of_data, true AS intact FROM region")
def meta_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).attachments().select("name", "mime", "size", F.md5("data").alias("md5_of_data"), "intact")


@query("meta_events", "SELECT r_name AS name, 6 AS type, CAST(r_regionkey * 5 AS DOUBLE) AS value FROM region")
def meta_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).events().select("name", "type", "value")


@query("meta_header", f"SELECT 420 AS version, CAST({_START} AS BIGINT) AS start_ns, CAST({_START // 1000} AS BIGINT) AS start_us, 'An Author' AS author, 'a & b' AS comment, '<none>' AS project")
def meta_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("comments")
    return _documents(spark, sf_dir).header().select("version", "start_ns", F.unix_micros("start_time").alias("start_us"), c["Author"].alias("author"), c["comment"].alias("comment"), c["project"].alias("project"))


@query("meta_file_history", f"SELECT CAST({_START} AS BIGINT) AS time_ns, 'written' AS comment, 'chanspark' AS tool")
def meta_file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).file_history().select("time_ns", "comment", F.col("tags")["tool_id"].alias("tool"))


@query("meta_sources", "SELECT * FROM (VALUES ('speed', 'engine', 'ECU 1'), ('speed gearbox', 'gearbox', 'ECU 2'), ('key', NULL, NULL)) t(name, source_name, source_path)")
def meta_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of one name are told apart by their sources."""
    path = place(spark)
    fields = [Field("key", 2, 32, 0), Field("speed", 2, 32, 0, source=("engine", "ECU 1")), Field("speed", 2, 32, 0, source=("gearbox", "ECU 2"))]
    samples.straddling(table(spark, sf_dir, "region").select("r_regionkey"), path, ["<i4"], fields)
    return mdf.MdfFile(spark, path).channels().select("name", "source_name", "source_path")


@query("meta_v3_header", "SELECT 330 AS version, CAST(1044072306000000000 AS BIGINT) AS start_ns, 'An Author' AS author, 'Org' AS organisation, 'Project' AS project, 'Subject' AS subject")
def meta_v3_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("comments")
    return mdf.MdfFile(spark, _version3(spark, sf_dir)).header().select("version", "start_ns", c["author"].alias("author"), c["organisation"].alias("organisation"), c["project"].alias("project"), c["subject"].alias("subject"))


@query("meta_channel", "SELECT 'o_totalprice' AS name, 'EUR' AS unit, 'price of the order' AS description, 'o_orderkey' AS master, 1 AS master_type, 'double' AS dtype, 420 AS version")
def meta_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit, description, master, its type, and the type of a channel, each asked for by name."""
    path = place(spark)
    df = mdf.set_master(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    mdf.save(mdf.set_description(mdf.set_unit(df, "o_totalprice", "EUR"), "o_totalprice", "price of the order"), path)
    f, n = mdf.MdfFile(spark, path), "o_totalprice"
    return spark.createDataFrame([(n, f.unit(n), f.description(n), f.master(n), f.master_type(n), f.dtype(n).simpleString(), f.version)], "name string, unit string, description string, master string, master_type int, dtype string, version int")


@query("meta_describe", "SELECT name, unit, first, last FROM (VALUES ('s_suppkey', '', (SELECT CAST(min(s_suppkey) AS VARCHAR) FROM supplier), (SELECT CAST(max(s_suppkey) AS VARCHAR) FROM supplier)), ('s_nationkey', 'nation', (SELECT CAST(s_nationkey AS VARCHAR) FROM supplier ORDER BY s_suppkey LIMIT 1), (SELECT CAST(s_nationkey AS VARCHAR) FROM supplier ORDER BY s_suppkey DESC LIMIT 1))) t(name, unit, first, last)")
def meta_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    df = mdf.set_unit(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").orderBy("s_suppkey"), "s_nationkey", "nation")
    mdf.save(df, path)
    return mdf.MdfFile(spark, path).describe().select("name", "unit", "first", "last")


# Several tables, edits and cuts of files

_BOTH = "SELECT 0 AS tag, o_orderkey AS key, o_totalprice AS value FROM orders UNION ALL SELECT 1, event_id, value FROM events"


def _both(spark: SparkSession, sf_dir: str) -> mdf.MdfFile:
    path = place(spark, "both.mf4")
    orders = mdf.set_master(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("price")), "order")
    events = mdf.set_master(table(spark, sf_dir, "events").select(F.col("event_id").alias("event"), "value"), "event")
    mdf.write_tables([orders, events], path)
    return mdf.MdfFile(spark, path)


def _tagged(frames: list[DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(k).alias("tag"), F.col(df.columns[0]).alias("key"), F.col(df.columns[1]).alias("value")) for k, df in enumerate(frames)]
    return parts[0].union(parts[1])


@query("write_multi", _BOTH)
def write_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of other lengths and masters in one file."""
    return _tagged(_both(spark, sf_dir).tables())


@query("write_multi_copy", _BOTH)
def write_multi_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of a file written to another one, compressed."""
    return _tagged(_both(spark, sf_dir).write(place(spark, "copy.mf4"), compression=True).tables())


@query("export_parquet_all", _BOTH)
def export_parquet_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = _both(spark, sf_dir)
    return _tagged([spark.read.parquet(p) for p in file.export_parquet(os.path.dirname(file.path), "gzip")])


@query("export_parquet_metadata", "SELECT * FROM (VALUES ('order', 'both.mf4', 'order'), ('price', 'both.mf4', 'order'), ('event', 'both.mf4', 'event'), ('value', 'both.mf4', 'event')) t(name, file_name, master_channel)")
def export_parquet_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = _both(spark, sf_dir)
    fields = [f for p in file.export_parquet(os.path.dirname(file.path)) for f in spark.read.parquet(p).schema]
    return spark.createDataFrame([(f.name, f.metadata["file_name"], f.metadata["master_channel"]) for f in fields], "name string, file_name string, master_channel string")


@query("edit_add_table", _BOTH)
def edit_add_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel with a master and a length of its own is added to a file."""
    path = place(spark)
    mdf.save(mdf.set_master(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("price")), "order"), path)
    events = mdf.set_master(table(spark, sf_dir, "events").select(F.col("event_id").alias("event"), "value"), "event")
    return _tagged(mdf.MdfFile(spark, path).add_table(events).tables())


@query("edit_file", "SELECT s_suppkey, s_acctbal + 1 AS balance, s_acctbal * 2 AS doubled FROM supplier")
def edit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels added, removed, renamed and set, written and read again."""
    first, second = place(spark), place(spark)
    mdf.save(mdf.set_master(_supplier(spark, sf_dir), "s_suppkey"), first)
    df = mdf.MdfFile(spark, first).table(0)
    df = mdf.remove_channel(mdf.add_channel(df, "doubled", F.col("s_acctbal") * 2, "EUR"), "s_nationkey")
    mdf.save(mdf.rename_channel(mdf.set_data(df, "s_acctbal", F.col("s_acctbal") + 1), "s_acctbal", "balance"), second)
    return mdf.MdfFile(spark, second).table(0)


@query("edit_metadata", "SELECT * FROM (VALUES ('s_suppkey', '', '', 's_suppkey', 1), ('s_acctbal', 'EUR', 'balance of the account', 's_suppkey', 0)) t(name, unit, description, master, sync_type)")
def edit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    df = mdf.set_master(_supplier(spark, sf_dir).select("s_suppkey", "s_acctbal"), "s_suppkey")
    mdf.save(mdf.set_description(mdf.set_unit(df, "s_acctbal", "EUR"), "s_acctbal", "balance of the account"), path)
    return mdf.MdfFile(spark, path).channels().select("name", "unit", "description", "master", "sync_type")


@query("cut_file", "SELECT event_id, value FROM events WHERE event_id BETWEEN 100 AND 900")
def cut_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of the master of a written file: only its row ranges are read."""
    path = place(spark)
    mdf.save(mdf.set_master(table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id"), "event_id"), path)
    return mdf.MdfFile(spark, path).window("value", 100, 900)


@query("cut_file_pushed", "SELECT event_id, value FROM events WHERE event_id BETWEEN 100 AND 900")
def cut_file_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an ordinary filter, which Spark pushes down to the source."""
    path = place(spark)
    mdf.save(mdf.set_master(table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id"), "event_id"), path, "rows", True)
    return ops.cut(mdf.MdfFile(spark, path).table(0), "event_id", 100, 900)


# Aggregates, metadata, edits, exports

@query("agg_min_max", "SELECT CAST(min(l_quantity) AS DOUBLE) AS min_l_quantity, CAST(max(l_quantity) AS DOUBLE) AS max_l_quantity, CAST(min(l_partkey) AS DOUBLE) AS min_l_partkey, CAST(max(l_partkey) AS DOUBLE) AS max_l_partkey FROM lineitem")
def agg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.min_max(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_partkey"])


@query("agg_max_len", "SELECT max(octet_length(encode(p_name))) AS len_p_name, max(octet_length(encode(p_type))) AS len_p_type FROM part")
def agg_max_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_length(table(spark, sf_dir, "part"), ["p_name", "p_type"])


@query("agg_row_count", "SELECT count(*) AS n FROM lineitem")
def agg_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the metadata alone."""
    path = place(spark)
    mdf.save(table(spark, sf_dir, "lineitem").select("l_orderkey"), path)
    return mdf.MdfFile(spark, path).channels().select(F.col("rows").alias("n"))


def _orders(spark: SparkSession, sf_dir: str) -> mdf.MdfFile:
    path = place(spark, "orders.mf4")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    mdf.save(mdf.set_unit(mdf.set_master(df, "o_orderkey"), "o_totalprice", "EUR"), path)
    return mdf.MdfFile(spark, path)


@query("meta_channel_names", "SELECT * FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('o_orderstatus')) AS t(name)")
def meta_channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).channels().select("name")


@query("meta_group_of_channel", "SELECT * FROM (VALUES ('o_orderkey', ''), ('o_custkey', ''), ('o_totalprice', 'EUR'), ('o_orderstatus', '')) AS t(name, unit)")
def meta_group_of_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = _orders(spark, sf_dir).channels()
    return channels.join(channels.where("name = 'o_totalprice'").select("table"), "table", "left_semi").select("name", "unit")


@query("meta_master_map", "SELECT 'o_orderkey' AS master, 'o_custkey,o_orderkey,o_orderstatus,o_totalprice' AS channels")
def meta_master_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).channels().groupBy("master").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("channels"))


@query("group_dataframe", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def group_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).group("o_custkey")


@query("export_parquet_group", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def export_parquet_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = _orders(spark, sf_dir)
    return spark.read.parquet(*file.export_parquet(os.path.dirname(file.path), "zstd", only="o_custkey"))


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")


@query("edit_add_channel", "SELECT s_suppkey, s_nationkey, s_acctbal, s_acctbal * 2 AS doubled FROM supplier")
def edit_add_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.add_channel(_supplier(spark, sf_dir), "doubled", F.col("s_acctbal") * 2, "EUR")


@query("edit_remove_channel", "SELECT s_suppkey, s_acctbal FROM supplier")
def edit_remove_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.remove_channel(_supplier(spark, sf_dir), "s_nationkey")


@query("edit_rename_channel", "SELECT s_suppkey, s_nationkey, s_acctbal AS balance FROM supplier")
def edit_rename_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.rename_channel(_supplier(spark, sf_dir), "s_acctbal", "balance")


@query("edit_set_data", "SELECT s_suppkey, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier")
def edit_set_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.set_data(_supplier(spark, sf_dir), "s_acctbal", F.col("s_acctbal") + 1)


def _version3(spark: SparkSession, sf_dir: str) -> str:
    path = place(spark, "file.mdf")
    channels = [{"name": "s_suppkey", "type": 1, "byte": 0, "bits": 64, "master": True}, {"name": "s_nationkey", "type": 0, "byte": 8, "bits": 32}, {"name": "s_acctbal", "type": 3, "byte": 12, "bits": 64, "unit": "EUR", "cc": (0, 2, samples.struct.pack("<dd", 1.0, 2.0))}]
    samples.version3_table(_supplier(spark, sf_dir), path, ["<i8", "<u4", "<f8"], channels)
    return path


_V3_SQL = "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal * 2 + 1 AS s_acctbal FROM supplier"


@query("v3_roundtrip", _V3_SQL)
def v3_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.MdfFile(spark, _version3(spark, sf_dir)).table(0)


@query("v3_to_v4", _V3_SQL)
def v3_to_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mdf.MdfFile(spark, _version3(spark, sf_dir)).write(place(spark), compression=True).table(0)


# Table operations

@query("cut_range", "SELECT event_id, value FROM events WHERE event_id BETWEEN 100 AND 900")
def cut_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cut(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 100, 900)


_EVENTS = "(SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000.0::DOUBLE AS t FROM events)"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00 UTC')) / 1000000D"))


@query("resample_mean", f"SELECT user_id, floor(t / 3600) * 3600 AS t, round(avg(value), 6) AS value FROM {_EVENTS} GROUP BY ALL")
def resample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resample(_timed(spark, sf_dir), "t", 3600, "mean", ["value"], ["user_id"]).withColumn("value", F.round("value", 6))


@query("resample_ffill", f"""
WITH e AS (SELECT user_id, t, value FROM {_EVENTS}), b AS (SELECT user_id, CAST(ceil(min(t) / 7200) AS BIGINT) AS a, CAST(floor(max(t) / 7200) AS BIGINT) AS z FROM e GROUP BY user_id),
g AS (SELECT user_id, unnest(range(a, z + 1)) * 7200.0::DOUBLE AS t FROM b)
SELECT g.user_id, g.t, e.value FROM g ASOF LEFT JOIN (SELECT user_id, t, max(value) AS value FROM e GROUP BY user_id, t) e ON g.user_id = e.user_id AND g.t >= e.t""")
def resample_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resample_previous(_timed(spark, sf_dir), "t", 7200, ["value"], ["user_id"])


@query("resample_interpolated", f"""
WITH e AS (SELECT t, max(value) AS value FROM {_EVENTS} GROUP BY t), b AS (SELECT CAST(ceil(min(t) / 7200) AS BIGINT) AS a, CAST(floor(max(t) / 7200) AS BIGINT) AS z FROM e),
g AS (SELECT unnest(range(a, z + 1)) * 7200.0::DOUBLE AS t FROM b),
p AS (SELECT g.t, e.t AS x0, e.value AS y0 FROM g ASOF LEFT JOIN e ON g.t >= e.t), n AS (SELECT p.*, e.t AS x1, e.value AS y1 FROM p ASOF LEFT JOIN e ON p.t <= e.t)
SELECT t, round(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (t - x0) / (x1 - x0) END, 6) AS value FROM n""")
def resample_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resample_linear(_timed(spark, sf_dir).groupBy("t").agg(F.max("value").alias("value")), "t", 7200, "value", block_steps=24).withColumn("value", F.round("value", 6))


@query("merge_asof", f"""
WITH e AS (SELECT event_id, t FROM {_EVENTS}), r AS (SELECT t, max(value) AS view_value FROM {_EVENTS} WHERE event_type = 'view' GROUP BY t)
SELECT e.event_id, e.t, r.view_value FROM e ASOF LEFT JOIN r ON e.t >= r.t""")
def merge_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _timed(spark, sf_dir)
    return ops.merge_asof(events.select("event_id", "t"), events.where("event_type = 'view'").select("t", F.col("value").alias("view_value")), "t", block=86400)


@query("concat_files", "SELECT event_id AS key, value, CAST(NULL AS BIGINT) AS extra FROM events UNION ALL SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
def concat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    mdf.register(spark)
    a, b = place(spark), place(spark)
    mdf.save(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "value"), a)
    mdf.save(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("extra")), b)
    return ops.concat([mdf.MdfFile(spark, p).table(0) for p in (a, b)])


@query("flagship", "SELECT event_type, count(*) AS n, round(avg(value * 0.5 + 1), 6) AS mean_physical FROM events GROUP BY event_type")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> a measurement file -> the data source -> a conversion -> aggregates per event type."""
    path = place(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    mdf.save(mdf.set_master(events, "event_id"), path)
    df = mdf.MdfFile(spark, path).table(0)
    value = to_physical(F.col("value"), T.DoubleType(), Conversion(4, 1, [1.0, 0.5]))[0]
    return df.select("event_type", value.alias("p")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_physical"))
