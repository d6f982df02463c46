"""Numbers as text: the shortest digits that read back as the same number, never with an exponent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def positional(x: float) -> str:
    """The same in Python, for one number."""
    return "NaN" if np.isnan(x) else np.format_float_positional(x, unique=True, trim="-")


def number_text(x: Column, kind: T.DataType) -> Column:
    """Spark's own digits, shortened where Java has some too many, and laid out without an exponent. Built-in functions
    throughout. What comes out reads back as the same number and is as short as can be; of several such texts (one number
    in 10,000 of arbitrary bits) it need not be the nearest."""
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return x.cast("string")
    x = x.cast("double")
    size = F.abs(x)
    raw = size.cast("string")  # "12.5", "7.0", "1.25E-5", "1.0E22"
    whole, part = F.regexp_extract(raw, r"^(\d+)", 1), F.regexp_extract(raw, r"\.(\d*?)0*(?:E|$)", 1)
    power = F.coalesce(F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    # The number is d times ten to the power e.
    number = F.struct(F.concat(whole, part).try_cast("long").alias("d"), (power - F.length(part)).alias("e"))

    def read(d: Column, e: Column) -> Column:
        return F.concat(d.cast("string"), F.lit("E"), e.cast("string")).try_cast("double") == size

    def step(s: Column) -> Column:
        """One digit less, if that reads back as the same number: Java's digits may be one or two more than it takes."""
        last = F.pmod(s["d"], F.lit(10).cast("long"))
        low, e = ((s["d"] - last).cast("decimal(20,0)") / 10).cast("long"), s["e"] + 1
        near, far = F.when(last < 5, low).otherwise(low + 1), F.when(last < 5, low + 1).otherwise(low)
        return F.when(read(near, e), F.struct(near.alias("d"), e.alias("e"))).when(read(far, e), F.struct(far.alias("d"), e.alias("e"))).otherwise(s)

    def bound(value: Column, f) -> Column:
        """f of a value that is computed once."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    odd = (F.length(raw) >= 17) | (size < 1e-300)
    number = bound(number, lambda s: F.when(odd, bound(step(s), lambda t: bound(step(t), step))).otherwise(s))

    def laid_out(s: Column) -> Column:
        digits = F.coalesce(F.nullif(F.rtrim(s["d"].cast("string"), F.lit("0")), F.lit("")), F.lit("0"))
        point, n = F.length(s["d"].cast("string")) + s["e"], F.length(digits)
        return (
            F.when(s["d"] == 0, F.lit("0"))
            .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )

    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    plain = x.cast("string")
    # Most numbers are whole or short, and need no more than one step.
    text = (
        F.when((x == F.rint(x)) & (size < 2.0**53) & (x != 0), x.cast("long").cast("string"))
        .when((size >= 1e-3) & (size < 1e7) & (F.length(plain) < 17), F.regexp_replace(plain, r"\.?0+$", ""))
        .when(F.isnan(x), F.lit("NaN"))
        .when(raw == "Infinity", F.concat(sign, F.lit("inf")))
        .otherwise(F.concat(sign, bound(number, laid_out)))
    )
    return F.when(x.isNotNull(), text)
