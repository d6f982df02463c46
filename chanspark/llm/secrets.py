"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

Patterns (assignments, access keys, long hexadecimal runs) are matched leftmost and without overlaps, each kind for
itself. Every other token of MIN_TOKEN or more characters with a letter in it is tested:
  1. the narrowest alphabet that fits is inferred (letters of one case, hexadecimal, base 32, 36, 52, 62, 64; hexadecimal
     digits in groups joined by '-' are read without the joints);
  2. chi-squared uniformity over cells of that alphabet, the runs test about its middle and lag-1 serial correlation each
     give a p-value under "drawn uniformly"; a token fails the battery if three times the smallest is below MIN_P;
  3. the likelihood ratio of "uniform" against characters of natural text is an e-value, which grows with the length;
     a document's tokens are held to a false-discovery rate of FDR by the e-BH rule over all its tested tokens, with a
     weight of PLAIN_WEIGHT for those of letters of one case (as long words are) and 1 for others, scaled to a mean of 1.
A token that fits no alphabet or does not pass (a path with a key in it, say) is split at '/', '+', '-' and '_'. Runs of parts
that look random together, or else single parts, are tested like tokens of their own, and count as such in the e-BH rule.
What passes both is a span of the kind "random", unless it overlaps a pattern's span. Spans count code points, the end
exclusive. All is decided inside a document; there is no shuffle.

Nulls: a null text is empty, without spans; redaction leaves it null. Repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN = 16
MIN_P = 0.003
FDR = 0.01
PLAIN_WEIGHT = 0.05
#: Logarithm of the least e-value with which any token can pass.
PASSES = -math.log(FDR)

_ANY = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)  # noqa: E731  either case, for ASCII letters only
_ASSIGN = re.compile(
    "(?:" + "|".join(map(_ANY, ("password", "passwd", "secret", "token"))) + "|" + _ANY("api") + "_?" + _ANY("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
_HEX = re.compile("[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)
_PART = re.compile("[A-Za-z0-9]+")
_GROUPS = re.compile("(?:[0-9a-f]{4,}(?:-[0-9a-f]{4,})+|[0-9A-F]{4,}(?:-[0-9A-F]{4,})+)")
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
#: Alphabet -> the value of each of its digits.
_SETS = {frozenset(a): {c: k for k, c in enumerate(a)} for a in _ALPHABETS}
#: Shares of letters in natural text (of all letters), and of the classes of characters in its long tokens. For plain words
#: a quarter of the weight goes to equal shares, as other languages have other rare letters.
_LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.2, 0.2, 0.1, 0.1), strict=True))
_MIXED = {c: 0.75 * s / sum(_LETTERS.values()) + 0.25 / 26 for c, s in _LETTERS.items()}
_NATURAL = {c: 0.84 * s / 100.1 for c, s in _LETTERS.items()} | {c.upper(): 0.05 * s / 100.1 for c, s in _LETTERS.items()} | {c: 0.007 for c in "0123456789"} | {c: 0.01 for c in "+/_-"}


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c, d, k = x + 1 - a, 1e300, 1 / (x + 1 - a), 0
    h = d
    for _ in range(500):
        k += 1
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def battery(values: list[int], size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for digits in base size."""
    n = len(values)
    cells = max(2, min(size, n // 5))
    expected = [0.0] * cells
    for v in range(size):
        expected[v * cells // size] += n / size
    seen = [0] * cells
    for v in values:
        seen[v * cells // size] += 1
    uniform = gamma_q((cells - 1) / 2, sum((o - e) ** 2 / e for o, e in zip(seen, expected, strict=True)) / 2)
    high = [2 * v >= size for v in values]
    up = sum(high)
    down = n - up
    if not up or not down:
        return uniform, 0.0, 0.0
    mean, spread = 1 + 2 * up * down / n, 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    normal = lambda z: math.erfc(abs(z) / math.sqrt(2))
    p_runs = normal((runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    centre = sum(values) / n
    square = sum((v - centre) ** 2 for v in values)
    serial = sum((a - centre) * (b - centre) for a, b in zip(values, values[1:], strict=False)) / square if square else 1.0
    return uniform, p_runs, normal((serial + 1 / n) * math.sqrt(n))


def log_e(token: str, size: int) -> float:
    """Logarithm of the likelihood ratio of uniform digits against natural text."""
    return sum(-math.log(size) - math.log(_NATURAL[c]) for c in token)


def _tested(token: str) -> float | None:
    """Logarithm of a token's e-value, -inf if it fits no alphabet or fails the battery; None if it is not to be tested."""
    if len(token) < MIN_TOKEN or token.isdecimal() or not any(c.isalpha() for c in token):
        return None
    if _GROUPS.fullmatch(token):
        token = token.replace("-", "")
    symbols = set(token)
    if token.isalpha() and token[1:].islower():
        token = token.lower()  # a capital in front is the custom of writing
        symbols = set(token)
    alphabet = next((a for a in _SETS if symbols <= a), None)
    if alphabet is None:
        return -math.inf
    digits = _SETS[alphabet]
    value = log_e(token, len(digits))
    if token.isalpha() and (token.islower() or token.isupper()):
        value = sum(-math.log(26) - math.log(_MIXED[c]) for c in token.lower())
    # Below zero no weight lets it pass, so the battery may be left out.
    return value if value < 0 or 3 * min(battery([digits[c] for c in token], len(digits))) >= MIN_P else -math.inf


def _weight(token: str) -> float:
    """Weight before scaling."""
    return PLAIN_WEIGHT if token.isalpha() and (token.isupper() or token[1:].islower()) else 1.0


def _runs(token: str, single: list[tuple[int, int]], separators: str) -> list[tuple[int, int]]:
    """First and last of the parts that, joined by these separators only, look random together: runs whose likelihood ratio
    no neighbours raise (Ruzzo and Tompa's maximal segments)."""
    done: list[tuple[int, int]] = []
    runs: list[tuple[int, int, float, float, int]] = []  # also the ratios up to start and end, and the nearest run before with a smaller one up to its start
    total, at = 0.0, 0
    for k, (x, y) in enumerate(single):
        if not set(token[at:x]) <= set(separators):
            done += [r[:2] for r in runs]
            runs, total = [], 0.0
        start = total + (log_e(token[at:x], 64) if runs else 0.0)
        first, total, at = k, start + log_e(token[x:y], 64), y
        while total > start:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= start:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= total:
                runs.append((first, k, start, total, j))
                break
            first, start = runs[j][0], runs[j][2]
            del runs[j:]
    return done + [r[:2] for r in runs]


def _parts(token: str) -> list[tuple[float, int, int]]:
    """What is tested of a token that does not pass as a whole: e-value, start and end."""
    single = [m.span() for m in _PART.finditer(token)]
    found, covered = [], set()
    for separators in ("+/", "-_"):  # no alphabet has both
        for first, last in _runs(token, single, separators):
            x, y = single[first][0], single[last][1]
            if last > first and y - x < len(token) and (value := _tested(token[x:y])) is not None:
                found.append((value, x, y))
                if value >= PASSES:
                    covered |= set(range(first, last + 1))
    found += [(value, x, y) for k, (x, y) in enumerate(single) if k not in covered and y - x < len(token) and (value := _tested(token[x:y])) is not None]
    return found


def random_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that the battery and the false-discovery rule let pass."""
    tested = []
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip("=")
        value = _tested(token)
        if value is not None:
            tested.append((value, _weight(token), m.span()))
        if value is None or value < PASSES:
            # Padding belongs to the part that it follows.
            tested += [(v, _weight(token[a:b]), (m.start() + a, m.end() if b == len(token) else m.start() + b)) for v, a, b in _parts(token)]
    weights = sum(w for _, w, _ in tested)
    # e-BH over weight / mean weight * e: the k-th passes at n / (k FDR), where the number n of tests cancels out.
    passing = sorted((math.log(w) + value, span) for value, w, span in tested)[::-1]
    most = max((k for k, (value, _) in enumerate(passing, 1) if value >= math.log(weights / (k * FDR))), default=0)
    return sorted(span for _, span in passing[:most])


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, number of the kind, end), in order."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    longest = max(map(len, text.split()), default=0)
    if longest >= 32:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if longest >= MIN_TOKEN:
        spans = random_tokens(text)
        if spans:
            base = sorted((a, b) for a, _, b in found)
            k = 0
            for a, b in spans:
                while k < len(base) and base[k][1] <= a:
                    k += 1
                if not any(x < b and a < y for x, y in base[max(0, k - 3) : k + 3]):
                    found.append((a, 3, b))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: counts of the patterns' spans, the digest of these, and all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()) for kind in range(3)]
        digests = [hashlib.sha256(joined([s for s in r if s[1] < 3]).encode()).hexdigest() for r in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(joined, rows), pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    return map_batches(rows, run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", key)


def redacted(text: str | None) -> str | None:
    """text with every stretch covered by spans replaced by the kind of the first of them."""
    spans = scan(text)
    if not spans:
        return text
    parts, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its secrets replaced in the text column; other columns stay as they are."""
    n = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[n] = pa.array([redacted(t) for t in batch.column(n).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    plain = [f"c{k}" for k in range(len(docs.columns))]  # names may hold dots, which Spark's map functions do not take
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema, strict=True)])
    return map_batches(docs.toDF(*plain), run, schema).toDF(*docs.columns)
