"""Channel conversions as Column expressions, so that they stay inside generated code.

Every conversion keeps null as null. Numbers are converted as doubles; a conversion to text gives text. What does not
apply to a channel's type (a number conversion of a text, say) leaves the raw value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.model import Conversion
from .formula import FormulaError, divide, formula, log
from .numbers import number_text

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_NUMBER = (*_WHOLE, T.FloatType, T.DoubleType)
#: Entries of a table up to which it is one chain of conditions; longer ones are halved.
CHAIN = 16


def identity(c: Conversion | None) -> bool:
    if c is None or c.kind in (65535,) or (c.version == 4 and c.kind == 0):
        return True
    if c.version == 3 and c.kind not in (0, 1, 2, 6, 7, 8, 9, 10, 11, 12):
        return True
    linear = c.kind == (1 if c.version == 4 else 0)
    return linear and (len(c.values) < 2 or (c.values[0] == 0 and abs(c.values[1] - 1) < 1e-12))


def to_physical(x: Column, kind: T.DataType, c: Conversion | None) -> tuple[Column, T.DataType]:
    """The physical value of a raw value of that type, and its type."""
    if identity(c):
        return x, kind
    if isinstance(kind, T.ArrayType):
        depth, inner = 0, kind
        while isinstance(inner, T.ArrayType):
            depth, inner = depth + 1, inner.elementType
        if not isinstance(inner, _NUMBER) or not (f := numeric(c)):
            return x, kind
        out: T.DataType = T.DoubleType()
        for _ in range(depth):
            out = T.ArrayType(out)
        return _deep(x, depth, lambda v: _nulls(v, f(v.cast("double"), isinstance(inner, _WHOLE)))), out
    if isinstance(kind, T.StructType) and (f := numeric(c)) and _kind(c) in ("linear", "rational", "formula"):
        part = lambda n: f(x[n].cast("double"), False).alias(n)
        return F.when(x.isNotNull(), F.struct(part("re"), part("im"))), T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    if isinstance(kind, _NUMBER):
        if f := numeric(c):
            return _nulls(x, f(x.cast("double"), isinstance(kind, _WHOLE))), T.DoubleType()
        if f := to_text(c):
            return _nulls(x, f(x, kind)), T.StringType()
    if isinstance(kind, T.StringType) and c.version == 4 and c.kind == 9:
        return _nulls(x, _lookup(x, c.refs, [F.lit(float(v)) for v in c.values], F.lit(float(c.values[len(c.refs)])) if len(c.values) > len(c.refs) else F.lit(None).cast("double"))), T.DoubleType()
    if isinstance(kind, T.StringType) and c.version == 4 and c.kind == 10:
        pairs = len(c.refs) // 2
        default = c.refs[2 * pairs] if len(c.refs) % 2 else None
        return _nulls(x, _lookup(x, c.refs[0 : 2 * pairs : 2], [F.lit(v) if isinstance(v, str) else x for v in c.refs[1 : 2 * pairs : 2]], F.lit(default) if isinstance(default, str) else x)), T.StringType()
    return x, kind


def _nulls(x: Column, value: Column) -> Column:
    return F.when(x.isNotNull(), value)


def _deep(x: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(x, f) if depth == 1 else F.transform(x, lambda y: _deep(y, depth - 1, f))


def _lookup(x: Column, keys: list, values: list[Column], default: Column) -> Column:
    seen, out = set(), None
    for k, v in zip(keys, values, strict=False):
        if isinstance(k, str) and k not in seen:
            seen.add(k)
            out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return default if out is None else out.otherwise(default)


_KINDS = {4: {1: "linear", 2: "rational", 3: "formula", 4: "interpolated", 5: "nearest", 6: "range", 7: "value text", 8: "range text", 11: "bits"}, 3: {0: "linear", 1: "interpolated", 2: "nearest", 6: "polynomial", 7: "exponential", 8: "logarithmic", 9: "rational", 10: "formula", 11: "text table", 12: "text range"}}


def _kind(c: Conversion) -> str:
    return _KINDS[c.version].get(c.kind, "")


def numeric(c: Conversion) -> Callable[[Column, bool], Column] | None:
    """For a conversion to numbers, a function of the raw value as a double and of whether it is a whole number."""
    p = [float(v) for v in c.values]
    match _kind(c):
        case "linear":
            return lambda x, _: x * p[1] + p[0]
        case "rational":
            return lambda x, _: divide(x * x * p[0] + x * p[1] + p[2], x * x * p[3] + x * p[4] + p[5])
        case "formula":
            try:
                formula(c.formula, F.lit(0.0))
            except FormulaError:
                return lambda x, _: x
            return lambda x, _: formula(c.formula, x)
        case "interpolated":
            return lambda x, _: table(x, p, _between)
        case "nearest":
            return lambda x, _: table(x, p, lambda x, a, b: F.when(x - a[0] > b[0] - x, F.lit(b[1])).otherwise(F.lit(a[1])))
        case "range":
            return lambda x, whole: ranges(x, [(p[k], p[k + 1], F.lit(p[k + 2])) for k in range(0, len(p) - 2, 3)], F.lit(p[-1]) if len(p) % 3 else F.lit(math.nan), whole)
        case "polynomial":
            return lambda x, _: divide(p[1] - p[3] * (x - p[4] - p[5]), p[2] * (x - p[4] - p[5]) - p[0])
        case "exponential":
            return lambda x, _: _inverse(x, p, log)
        case "logarithmic":
            return lambda x, _: _inverse(x, p, F.exp)
    return None


def _inverse(x: Column, p: list[float], f: Callable[[Column], Column]) -> Column:
    if p[3] == 0:
        return divide(f(divide((x - p[6]) * p[5] - p[2], F.lit(p[0]))), F.lit(p[1]))
    if p[0] == 0:
        return divide(f(divide(divide(F.lit(p[2]), x - p[6]) - p[5], F.lit(p[3]))), F.lit(p[4]))
    return x


def _between(x: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    return (F.lit(a[1]) * (b[0] - x) + F.lit(b[1]) * (x - a[0])) / (b[0] - a[0])


def table(x: Column, p: list[float], between: Callable[..., Column]) -> Column:
    """A value from pairs (key, value) in order of keys, as a balanced tree of conditions; clamped at both ends, NaN stays."""
    pairs: list[tuple[float, float]] = []
    for k in range(0, len(p) - 1, 2):
        if not pairs or p[k] > pairs[-1][0]:
            pairs.append((p[k], p[k + 1]))
    if not pairs:
        return x

    def part(low: int, high: int) -> Column:  # keys low <= x < high
        if high - low == 1:
            a, b = pairs[low], pairs[high]
            return F.when(x == a[0], F.lit(a[1])).otherwise(between(x, a, b))
        middle = (low + high) // 2
        return F.when(x < pairs[middle][0], part(low, middle)).otherwise(part(middle, high))

    inner = part(0, len(pairs) - 1) if len(pairs) > 1 else F.lit(pairs[0][1])
    return F.when(F.isnan(x), x).when(x <= pairs[0][0], F.lit(pairs[0][1])).when(x >= pairs[-1][0], F.lit(pairs[-1][1])).otherwise(inner)


def ranges(x: Column, rows: list[tuple[float, float, Column]], default: Column, closed: bool) -> Column:
    """The value of the first range that x lies in: both ends included for whole numbers, else the lower one only."""
    if not rows:
        return default
    ordered = all(a[0] <= a[1] <= b[0] for a, b in zip(rows, rows[1:], strict=False))

    def chain(part: list[tuple[float, float, Column]]) -> Column:
        out = None
        for low, high, value in part:
            inside = (x >= low) & ((x <= high) if closed else (x < high) | (x == low if low == high else F.lit(False)))
            out = F.when(inside, value) if out is None else out.when(inside, value)
        return out.otherwise(default)

    def halved(part: list[tuple[float, float, Column]]) -> Column:
        if len(part) <= CHAIN:
            return chain(part)
        middle = len(part) // 2
        # A border that belongs to two ranges belongs to the first of them.
        before = x <= part[middle - 1][1]
        return F.when(before | (x < part[middle][0]), halved(part[:middle])).otherwise(halved(part[middle:]))

    return halved(rows) if ordered and closed else chain(rows)


def _text(ref: object, x: Column, kind: T.DataType) -> Column:
    """A text, a nested conversion's result as text, or the number itself as text."""
    if isinstance(ref, str):
        return F.lit(ref)
    if isinstance(ref, Conversion):
        if f := numeric(ref):
            return number_text(f(x.cast("double"), isinstance(kind, _WHOLE)), T.DoubleType())
        if f := to_text(ref):
            return f(x, kind)
    return number_text(x, kind)


def to_text(c: Conversion) -> Callable[[Column, T.DataType], Column] | None:
    """For a conversion to text, a function of the raw value and its type."""
    match _kind(c):
        case "value text":
            return lambda x, kind: _value_text(c, x, kind)
        case "range text":
            return lambda x, kind: ranges(x.cast("double"), [(float(c.values[2 * k]), float(c.values[2 * k + 1]), _text(c.refs[k], x, kind)) for k in range(len(c.values) // 2)], _text(_at(c.refs, len(c.values) // 2), x, kind), True)
        case "bits":
            return lambda x, kind: _bits(c, x, kind)
        case "text table":
            return lambda x, kind: _first(x.cast("double"), c)
        case "text range":
            return lambda x, kind: ranges(x.cast("double"), [(float(c.values[2 * k]), float(c.values[2 * k + 1]), F.lit(c.refs[k])) for k in range(1, len(c.refs))], F.lit(c.refs[0]) if c.refs else F.lit(""), False)
    return None


def _at(refs: list, k: int) -> object:
    return refs[k] if k < len(refs) else None


def _value_text(c: Conversion, x: Column, kind: T.DataType) -> Column:
    whole = isinstance(kind, _WHOLE)
    y = x if whole else F.rint(x.cast("double") * 2**20)
    out, seen = None, set()
    for k, v in enumerate(c.values):
        key = round(v) if whole else float(round(v * 2**20)) if math.isfinite(v) else None
        if key is None or key in seen:
            continue
        seen.add(key)
        value = _text(_at(c.refs, k), x, kind)
        out = F.when(y == F.lit(key), value) if out is None else out.when(y == F.lit(key), value)
    default = _text(_at(c.refs, len(c.values)), x, kind)
    return default if out is None else out.otherwise(default)


def _first(x: Column, c: Conversion) -> Column:
    out = None
    for v, t in zip(c.values, c.refs, strict=False):
        out = F.when(x == float(v), F.lit(t)) if out is None else out.when(x == float(v), F.lit(t))
    return F.lit(c.refs[0] if c.refs else "") if out is None else out.otherwise(F.lit(c.refs[0]))


def _bits(c: Conversion, x: Column, kind: T.DataType) -> Column:
    """A piece of text for each mask, each behind " | "; pieces of nothing are left out."""
    if not isinstance(kind, _WHOLE):
        return number_text(x, kind)
    y, pieces = x.cast("long"), []
    for mask, ref in zip(c.values, c.refs, strict=False):
        if not isinstance(ref, Conversion) or not (f := to_text(ref)):
            continue
        signed = int(mask) - (1 << 64) if int(mask) >= 1 << 63 else int(mask)
        piece = f(y.bitwiseAND(F.lit(signed).cast("long")), T.LongType())
        head = f" | {ref.name} = " if ref.name else " | "
        pieces.append(F.coalesce(F.concat(F.lit(head), piece), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")
