import math

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chanspark.operators import tables as ops


@pytest.mark.parametrize("most", [None, 7])
def test_asof_equals_pandas(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(ops, "ASOF_ROWS", most)
        found = ops._block([spark.createDataFrame([(0, 0.0), (0, 50.0), *((1, float(k)) for k in range(11))], "g int, t double")], "t", ["g"])
        assert found == 5.0
    left = pd.DataFrame({"g": [k % 3 for k in range(200)], "t": [float((k * 37) % 101) for k in range(200)], "k": range(200)})
    right = pd.DataFrame({"g": [k % 3 for k in range(60)], "t": [float(k * 1.7) for k in range(60)], "v": range(60)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="g").set_index("k")["v"]
    for block in (None, 5.0, 1000.0):
        got = {r.k: r.v for r in ops.merge_asof(spark.createDataFrame(left), spark.createDataFrame(right), "t", ["g"], block).collect()}
        assert {k: None if pd.isna(v) else v for k, v in want.items()} == got
    with pytest.raises(ValueError):
        ops.merge_asof(spark.createDataFrame(left), spark.createDataFrame(left), "t")


def test_null_masters(spark):
    a = spark.createDataFrame([(None, 1), (1.0, 2)], "t double, k int")
    b = spark.createDataFrame([(None, 9), (0.5, 8)], "t double, v int")
    assert {(r.k, r.v) for r in ops.merge_asof(a, b, "t", block=1.0).collect()} == {(1, None), (2, 8)}
    assert [r.k for r in ops.cut(a, "t", 0.0).collect()] == [2]


@pytest.mark.parametrize("how", ["mean", "min", "max", "sum", "count", "first", "last"])
def test_resample(spark, how):
    df = spark.createDataFrame([(0.1, 1.0), (0.9, 3.0), (2.5, 5.0), (None, 9.0), (-0.5, 7.0)], "t double, v double")
    got = {r.t: r.v for r in ops.resample(df, "t", 1.0, how).collect()}
    assert got == {"mean": {0: 2, 2: 5, -1: 7}, "min": {0: 1, 2: 5, -1: 7}, "max": {0: 3, 2: 5, -1: 7}, "sum": {0: 4, 2: 5, -1: 7}, "count": {0: 2, 2: 1, -1: 1}, "first": {0: 1, 2: 5, -1: 7}, "last": {0: 3, 2: 5, -1: 7}}[how]


def test_resample_on_a_grid(spark):
    df = spark.createDataFrame([(0.5, 1.0), (2.0, 4.0), (5.5, 11.0)], "t double, v double")
    assert {r.t: r.v for r in ops.resample_previous(df, "t", 1.0, ["v"], block_steps=2).collect()} == {1: 1, 2: 4, 3: 4, 4: 4, 5: 4}
    assert {r.t: r.v for r in ops.resample_linear(df, "t", 1.0, "v", block_steps=2).collect()} == pytest.approx({1: 2, 2: 4, 3: 6, 4: 8, 5: 10})


@pytest.mark.parametrize("block_steps", [3, 10_000])
def test_previous_values_of_series_equal_pandas(spark, block_steps):
    """Series with gaps, equal masters, nulls, one row, no grid point, masters below zero, steps that are not exact."""
    step = 0.1
    rows = [(k % 4, (k * 37 % 101 - 50) * 0.1 * (1 + k % 4), None if k % 7 == 0 else k) for k in range(150)] + [(8, -3.0, 1), (8, 40.0, 2), (9, 0.05, 3), (None, 0.3, 4), (None, 1.0, 5), (8, None, 6), (8, 40.0, 7)]
    got = sorted(((r.g, r.t, r.v) for r in ops.resample_previous(spark.createDataFrame(rows, "g int, t double, v int"), "t", step, ["v"], ["g"], block_steps).collect()), key=repr)
    want = []
    for g in {r[0] for r in rows}:
        own = sorted(((t, -1 if v is None else v) for h, t, v in rows if h == g and t is not None))
        for n in range(math.ceil(own[0][0] / step), math.floor(own[-1][0] / step) + 1):
            v = next((v for t, v in reversed(own) if t <= n * step), None)
            want.append((g, n * step, None if v == -1 else v))
    assert got == sorted(want, key=repr) and len(got) > 500


def test_grid_points_are_not_sorted(spark):
    """A grid far larger than its table goes through no shuffle."""
    df = spark.range(0, 1000, 1, 2).select((F.col("id") % 10).alias("g"), (F.col("id") * 100.0).alias("t"), "id")
    out = ops.resample_previous(df, "t", 1.0, ["id"], ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    made = max(k for k, line in enumerate(plan) if "Generate" in line)
    assert made < min(k for k, line in enumerate(plan) if "Exchange" in line or "Sort " in line)
    assert out.count() == 10 * 99_001
    assert out.where("id > t / 100 or id <= t / 100 - 10").count() == 0


def test_aggregates(spark):
    df = spark.createDataFrame([([1, 5], [[1.0], [-2.0]], "é"), (None, None, None)], "a array<int>, b array<array<double>>, `s.x` string")
    r = ops.min_max(df, ["a", "b"]).first()
    assert (r.min_a, r.max_a, r.min_b, r.max_b) == (1, 5, -2, 1) and ops.max_length(df, ["s.x"]).first()[0] == 2
    x = spark.range(1).select(ops.extract_bits(F.lit(0b1011000), 3, 4).alias("u"), ops.extract_bits(F.lit(0b1011000), 3, 4, True).alias("s")).first()
    assert (x.u, x.s) == (0b1011, 0b1011 - 16)
    assert ops.concat([spark.range(1), spark.sql("select 2L id, 'x' y")]).count() == 2


def test_shared_folder():
    """Without spark.checkpoint.dir a local folder will do only where all runs on one machine."""
    from types import SimpleNamespace

    from chanspark.session import shared_base, shared_dir

    session = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: folder or other), sparkContext=SimpleNamespace(master=master))
    assert shared_base(session("spark://host:7077", "hdfs://store/shared/")) == "hdfs://store/shared"
    assert shared_dir(session("local[4]")) != shared_dir(session("local[4]")) and shared_base(session("local"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_base(session(master))


def test_remove(spark):
    from chanspark.session import remove, shared_dir

    folder = shared_dir(spark)
    spark.range(3).write.parquet(folder)
    remove(spark, folder)
    with pytest.raises(AnalysisException):
        spark.read.parquet(folder)
