import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chanspark.functions.conversion import to_physical
from chanspark.functions.formula import FormulaError, formula
from chanspark.functions.numbers import positional
from chanspark.sources.model import Conversion

POINTS = [3, -5, 9, -2, 12, 0, 15, 1, 17, 2, 19, 0, 21, 3, 23, 6, 25, 3, 27, 0]


def convert(spark, values, kind, conversion):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(to_physical(F.col("x"), df.schema["x"].dataType, conversion)[0]).collect()]


def test_linear(spark):
    assert convert(spark, list(range(10)), "int", Conversion(4, 1, [-4.8, -3.2])) == [i * -3.2 + -4.8 for i in range(10)]
    assert convert(spark, list(range(10)), "int", Conversion(4, 1, [3, 0])) == [3.0] * 10
    assert to_physical(F.lit(1), T.IntegerType(), Conversion(4, 1, [0, 1]))[1] == T.IntegerType()


def test_formula(spark):
    assert convert(spark, list(range(10)), "int", Conversion(4, 3, formula="X*X+1")) == [1, 2, 5, 10, 17, 26, 37, 50, 65, 82]
    assert convert(spark, [4], "int", Conversion(4, 3, formula="not ( a formula")) == [4.0]


@pytest.mark.parametrize(("text", "value"), [
    ("2+3*4", 14), ("2^3^2", 512), ("-2^2", -4), ("2^-1", 0.5), ("(1+2)*3", 9), ("10%4", 2), ("7/2", 3.5), ("X>1 and X<3", 1), ("X>=2 || 0", 1), ("!X", 0), ("max(1,X,3)", 3), ("min(4,X)", 2), ("log(100)", 2), ("log(2,8)", 3),
    ("round(2.6)", 3), ("round(0.5, 2.3)", 2.5), ("int(-2.7)", -2), ("abs(-3)", 3), ("sign(-3)", -1), ("pi()", math.pi), ("e()", math.e), ("sqrt(X+2)", 2), ("sin(0)+cos(0)", 1), ("1/0", math.inf), ("-1/0", -math.inf), ("1e3", 1000), ("X1*2", 4), ("pow(2,5)", 32), ("exp(0)", 1), ("ln(e())", 1),
])
def test_formula_grammar(spark, text, value):
    assert spark.range(1).select(formula(text, F.lit(2.0)).cast("double")).first()[0] == pytest.approx(value)


@pytest.mark.parametrize("text", ["", "1+", "(1", "foo(1)", "1 2", "sin()", "X;", "__import__('os')"])
def test_bad_formulas(spark, text):
    with pytest.raises(FormulaError):
        formula(text, F.lit(1.0))


def test_tables(spark):
    interpolated = [-5] * 4 + [-4.5, -4, -3.5, -3, -2.5, -2, -4 / 3, -2 / 3, 0, 1 / 3, 2 / 3, 1, 1.5, 2, 1, 0, 1.5, 3, 4.5, 6, 4.5, 3, 1.5, 0, 0, 0]
    nearest = [-5] * 7 + [-2] * 4 + [0] * 3 + [1] * 3 + [2] * 2 + [0] * 2 + [3] * 2 + [6] * 2 + [3] * 2 + [0] * 3
    for version, kinds in ((4, (4, 5)), (3, (1, 2))):
        assert convert(spark, list(range(30)), "int", Conversion(version, kinds[0], POINTS)) == pytest.approx(interpolated)
        assert convert(spark, list(range(30)), "int", Conversion(version, kinds[1], POINTS)) == nearest
    odd = convert(spark, [math.nan, None, math.inf], "double", Conversion(4, 4, POINTS))
    assert math.isnan(odd[0]) and odd[1:] == [None, 0.0]


def test_range_to_value(spark):
    table = [6, 8, 0, 9, 10, 1, 11, 15, 2, 16, 17, 3, 18, 20, 5, 21, 21, 6, 22, 23, 7, 24, 25, 8, 26, 29, 9, -1]
    assert convert(spark, list(range(30)), "int", Conversion(4, 6, table)) == [-1] * 6 + [0] * 3 + [1] * 2 + [2] * 5 + [3] * 2 + [5] * 3 + [6] + [7] * 2 + [8] * 2 + [9] * 4
    assert convert(spark, [8.0, 7.9, 21.0], "double", Conversion(4, 6, table)) == [-1, 0, 6]
    many = [v for k in range(100) for v in (10 * k, 10 * k + 9, k)] + [-1]
    assert convert(spark, [-1, 0, 9, 10, 555, 999, 1000, None], "int", Conversion(4, 6, many)) == [-1, 0, 0, 1, 55, 99, -1, None]


def test_to_text(spark):
    gears = ["first gear", "second gear", "third gear", "fourth gear", "fifth gear"]
    assert convert(spark, list(range(10)), "int", Conversion(4, 7, [1, 2, 3, 4, 5], [*gears, "No match"])) == ["No match", *gears] + ["No match"] * 4
    names = ["very low", "low", "medium", "high"]
    assert convert(spark, list(range(10)), "int", Conversion(4, 8, [1, 3, 4, 5, 6, 7, 8, 9], [*names, "Out of range"])) == ["Out of range"] + ["very low"] * 3 + ["low"] * 2 + ["medium"] * 2 + ["high"] * 2
    nested = Conversion(4, 8, [9.9999, 10.1001, 20, 30], ["Illegal value", "Out of range", Conversion(4, 3, formula="10/(X-10)")])
    got = convert(spark, [0.1 * k for k in range(300)], "double", nested)
    assert (got[0], got[101], got[299]) == ("-1", "Illegal value", "Out of range")
    assert convert(spark, [0.1, None, 1.0, 1e20, 1e-7], "double", Conversion(4, 7, [0.1], ["a tenth", None])) == ["a tenth", None, "1", "100000000000000000000", "0.0000001"]
    assert convert(spark, [0, 1, 6, None], "int", Conversion(4, 11, [1, 6], [Conversion(4, 7, [0, 1], ["even", "odd"], name="p"), Conversion(4, 8, [0, 2, 4, 6], ["low", "high"])])) == [" | p = even | low", " | p = odd | low", " | p = even | high", None]


def test_from_text(spark):
    digits = "zero one two three four five six seven eight nine".split()
    assert convert(spark, [*digits, None], "string", Conversion(4, 9, [*range(1, 10), -50], digits[1:])) == [-50, *range(1, 10), None]
    german = "Eins Zwei Drei Vier Fünf Sechs Sieben Acht Neun".split()
    refs = [x for pair in zip(digits[1:], german, strict=True) for x in pair]
    assert convert(spark, digits, "string", Conversion(4, 10, [], [*refs, "No translation"])) == ["No translation", *german]
    assert convert(spark, digits[:2], "string", Conversion(4, 10, [], [*refs, None])) == ["zero", "Eins"]


def test_version3(spark):
    assert convert(spark, [1.0, 2.0, None], "double", Conversion(3, 6, [1, 2, 3, 4, 0, 0])) == [(2 - 4) / (3 - 1), (2 - 8) / (6 - 1), None]
    assert convert(spark, [2.0], "double", Conversion(3, 7, [2, 4, 1, 0, 0, 1, 0]))[0] == pytest.approx(math.log((2 - 1) / 2) / 4)
    assert convert(spark, [2.0], "double", Conversion(3, 8, [0, 0, 6, 2, 4, 1, 1]))[0] == pytest.approx(math.exp((6 / (2 - 1) - 1) / 2) / 4)
    assert convert(spark, [1.0, 2.0, 9.0], "double", Conversion(3, 11, [1, 2], ["one", "two"])) == ["one", "two", "one"]
    assert convert(spark, [1.0, 5.0, 9.0], "double", Conversion(3, 12, [0, 0, 1, 5, 5, 8], ["else", "a", "b"])) == ["a", "b", "else"]
    assert convert(spark, [3], "int", Conversion(3, 65535)) == [3]


def test_rational_and_arrays(spark):
    assert convert(spark, [0.0, 1.0], "double", Conversion(4, 2, [0, 0, 1, 0, 1, 0])) == [math.inf, 1.0]
    assert convert(spark, [[1, 2], None, [3]], "array<int>", Conversion(4, 1, [1, 2])) == [[3.0, 5.0], None, [7.0]]
    assert convert(spark, [[[1], [2]]], "array<array<int>>", Conversion(4, 1, [1, 2])) == [[[3.0], [5.0]]]
    assert tuple(convert(spark, [(1.0, 2.0)], "struct<re double, im double>", Conversion(4, 1, [1, 2]))[0]) == (3.0, 5.0)


def test_positional():
    assert [positional(x) for x in (1.0, 1e20, 0.1 + 0.2, 1e-7, -0.0, math.inf, math.nan)] == ["1", "100000000000000000000", "0.30000000000000004", "0.0000001", "-0", "inf", "NaN"]


def test_number_text_is_the_shortest(spark):
    """Digits as the shortest that read back, without an exponent, over all magnitudes; no Python in the plan."""
    import random
    import struct

    import numpy as np
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from chanspark.functions.numbers import number_text

    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -7.0, 0.1, 100.0, 1e7, 9999999.0, 1e22, 1e23, 123456789012345680.0, 2.0**53, 1e-3, 9.99e-4, 2e-3, 1.5e-7, 5e-324, 1.7976931348623157e308, float("inf"), -float("inf"), float("nan"), 12.5, -3.25e-12, 2.0e-3, 1.0e300]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [round(rng.uniform(-1e4, 1e4), rng.randint(0, 6)) for _ in range(2000)] + [float(rng.randint(-(10**17), 10**17)) for _ in range(500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*values, None])], "k long, v double").select("k", "v", number_text(F.col("v"), T.DoubleType()).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        want = None if r.v is None else "NaN" if r.v != r.v else np.format_float_positional(r.v, unique=True, trim="-")
        assert r.t == want, (r.v, r.t, want)
