"""Formulas of one variable X as Column expressions: a tokenizer and a parser by precedence; nothing is evaluated in Python.

Weakest first: or (||), and (&&), comparisons, + and -, * / %, unary minus and !, ^ (to the right). Numbers, X or X1,
constants e() and pi(), and the functions of FUNCTIONS. Comparisons give 1 or 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(\|\||&&|==|!=|<=|>=|[-+*/%^()<>!,]))")

_one = lambda f: (1, 1, f)
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "int": _one(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")), "ceil": _one(lambda x: F.ceil(x).cast("double")), "floor": _one(lambda x: F.floor(x).cast("double")), "abs": _one(F.abs), "sign": _one(F.signum),
    "sqrt": _one(lambda x: F.when(x < 0, F.lit(math.nan)).otherwise(F.sqrt(x))), "exp": _one(F.exp), "ln": _one(lambda x: log(x)), "sin": _one(F.sin), "cos": _one(F.cos), "tan": _one(F.tan), "asin": _one(F.asin), "acos": _one(F.acos), "atan": _one(F.atan),
    "sinh": _one(F.sinh), "cosh": _one(F.cosh), "tanh": _one(F.tanh), "asinh": _one(F.asinh), "acosh": _one(F.acosh), "atanh": _one(F.atanh),
    "log": (1, 2, lambda a, b=None: log(a) / math.log(10) if b is None else divide(log(b), log(a))),
    "round": (1, 2, lambda a, b=None: F.round(a) if b is None else divide(F.round(divide(b, a)), F.lit(1.0)) * a),
    "min": (1, 99, lambda *a: F.least(*a) if len(a) > 1 else a[0]), "max": (1, 99, lambda *a: F.greatest(*a) if len(a) > 1 else a[0]), "pow": (2, 2, lambda a, b: F.pow(a, b)),
    "e": (0, 0, lambda: F.lit(math.e)), "pi": (0, 0, lambda: F.lit(math.pi)),
}


class FormulaError(ValueError):
    pass


def divide(a: Column, b: Column) -> Column:
    """Floating-point division as in IEEE 754: by zero gives an infinity or NaN, where Spark's raises or gives null."""
    zero = F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b).otherwise(F.lit(1.0)))


def log(x: Column) -> Column:
    """Natural logarithm; NaN below zero and minus infinity at zero, where Spark's is null."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.ln(F.when(x > 0, x).otherwise(F.lit(1.0))))


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at:at + 10]!r} in {text!r}")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("sign", m[3]))
        at = m.end()
    return out


_BINARY = [("||", "or"), ("&&", "and"), ("==", "!=", "<=", ">=", "<", ">"), ("+", "-"), ("*", "/", "%")]


class _Parser:
    def __init__(self, text: str, x: Column):
        self.left, self.x, self.text = tokens(text), x, text

    def next_is(self, *values: str) -> str | None:
        if self.left and self.left[0][0] != "number" and self.left[0][1] in values:
            return self.left.pop(0)[1]
        return None

    def binary(self, level: int = 0) -> Column:
        if level == len(_BINARY):
            return self.unary()
        value = self.binary(level + 1)
        while sign := self.next_is(*_BINARY[level]):
            value = self.apply(sign, value, self.binary(level + 1))
        return value

    @staticmethod
    def apply(sign: str, a: Column, b: Column) -> Column:
        number = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
        match sign:
            case "||" | "or":
                return number((a != 0) | (b != 0))
            case "&&" | "and":
                return number((a != 0) & (b != 0))
            case "==":
                return number(a == b)
            case "!=":
                return number(a != b)
            case "<=":
                return number(a <= b)
            case ">=":
                return number(a >= b)
            case "<":
                return number(a < b)
            case ">":
                return number(a > b)
            case "+":
                return a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return divide(a, b)
        return F.when(b == 0, F.lit(math.nan)).otherwise(a % F.when(b != 0, b).otherwise(F.lit(1.0)))

    def unary(self) -> Column:
        if self.next_is("-"):
            return -self.unary()
        if self.next_is("+"):
            return self.unary()
        if self.next_is("!"):
            return F.when(self.unary() == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        base = self.atom()
        return F.pow(base, self.unary()) if self.next_is("^") else base

    def atom(self) -> Column:
        if self.next_is("("):
            value = self.binary()
            self.expect(")")
            return value
        if not self.left:
            raise FormulaError(f"{self.text!r} ends too early")
        kind, token = self.left.pop(0)
        if kind == "number":
            return F.lit(float(token))
        if kind == "name" and token.upper() in ("X", "X1"):
            return self.x
        if kind == "name" and token.lower() in FUNCTIONS:
            least, most, f = FUNCTIONS[token.lower()]
            self.expect("(")
            args = []
            if not self.next_is(")"):
                args.append(self.binary())
                while self.next_is(","):
                    args.append(self.binary())
                self.expect(")")
            if not least <= len(args) <= most:
                raise FormulaError(f"{token} takes {least} to {most} values in {self.text!r}")
            return f(*args)
        raise FormulaError(f"unexpected {token!r} in {self.text!r}")

    def expect(self, sign: str) -> None:
        if not self.next_is(sign):
            raise FormulaError(f"{sign!r} is missing in {self.text!r}")


def formula(text: str, x: Column) -> Column:
    """text as a Column of x, a double."""
    p = _Parser(text, x)
    value = p.binary()
    if p.left:
        raise FormulaError(f"unexpected {p.left[0][1]!r} in {text!r}")
    return value
