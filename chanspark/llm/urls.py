"""URL filters: rules and globs as one bit-parallel wildcard automaton.

All patterns are laid end to end in one Shift-And state, a number of as many machine words as it takes: bit i says that
pattern characters up to i have been matched. A character shifts the state, lets in the first bits, and masks by the
character; a wildcard adds no bit but a loop on the bit before it. One pass over a URL so runs all patterns at once.

The automaton reads a canonical URL: a dot, the host, a separator, the path, a separator, the query (all of it is read,
whole). A rule host/path fits the host and all its subdomains, and every path that starts with its path, whatever the query. Of the
rules that fit, the longest decides (then the first in the list); without any, the globs of the method decide: a URL that
one of them fits is blocked, any other allowed.

A glob is "host", "host/path" or either with a space and the query behind it; a part that is left out may be anything. In it, *
stands for any characters (of that part), ? for one, ^ for one of the separators SEPARATORS; letters are of either case. A
glob that begins with ^ may begin at any separator of the host, also before its first character. Rules and globs can be
read from tables (judge_of), MAX_PATTERNS of them at most, as they travel with every task.

Nulls: a null URL, or one without "://", has an empty host, path and query; no rule fits it and it is allowed. Repeated rows
are judged one by one. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: verdict and "host/path" of the rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that a host of the method's own filter may not have between separators, by what they stand for.
HOST_WORDS = (
    *("casino", "poker", "bets", "betting", "lottery", "slots", "jackpot"),  # gambling
    *("adult", "porn", "xxx", "sex", "escort", "webcams"),
    *("ads", "adserver", "adservice", "banners", "track", "tracker", "tracking", "clicks", "popunder"),  # adverts
    *("spam", "cheap", "pills", "viagra", "cialis", "pharma", "replica", "payday"),  # spam
    *("warez", "torrent", "torrents", "crack", "cracked", "keygen"),  # piracy
)
#: Endings of paths that hold no text.
FILE_TYPES = ("jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "css", "js", "woff", "mp3", "mp4", "avi", "mov", "zip", "gz", "rar", "7z", "exe", "dmg", "iso", "apk")
#: Parameters of queries that make a page's address one visitor's own.
SESSION_PARAMETERS = ("sessionid", "phpsessid", "jsessionid", "sid")
FILTERS = (*(f"^{w}^*" for w in HOST_WORDS), *(f"*/*.{t}" for t in FILE_TYPES), *(f"*/* {before}{p}=*" for p in SESSION_PARAMETERS for before in ("", "*&")))
SEPARATORS = ".-_/&=:"
MAX_PATTERNS = 20_000
_SEPARATOR = -1


@dataclass(frozen=True)
class Pattern:
    """Symbols (sets of code points, or of the separator between parts; None: any one character), and where wildcards
    stand (before which symbols; len(symbols): at the end)."""

    symbols: tuple[frozenset[int] | None, ...]
    stars: frozenset[int]


_BORDER = frozenset({_SEPARATOR})


def rule_pattern(rule: str) -> Pattern:
    """A host/path rule: any subdomain, a path prefix, any query."""
    host, slash, path = rule.partition("/")
    symbols = [*(frozenset({ord(c)}) for c in "." + host), _BORDER, *(frozenset({ord(c)}) for c in slash + path)]
    return Pattern((*symbols, _BORDER), frozenset({0, len(symbols), len(symbols) + 1}))


def glob_pattern(glob: str) -> Pattern:
    """A glob over host, path and query."""
    rest, _, query = glob.partition(" ")
    host, slash, path = rest.partition("/")
    symbols: list[frozenset[int] | None] = []
    stars: set[int] = set()
    if host.startswith("^"):
        stars.add(0)
    else:
        symbols.append(frozenset({ord(".")}))
    for n, part in enumerate((host, slash + path or "*", query or "*")):
        if n:
            symbols.append(_BORDER)
        for c in part:
            if c == "*":
                stars.add(len(symbols))
            else:
                symbols.append(None if c == "?" else frozenset(map(ord, SEPARATORS if c == "^" else {c.lower(), c.upper()} if c.isascii() else c)))
    return Pattern(tuple(symbols), frozenset(stars))


class Automaton:
    """Shift-And over all patterns. State bit 0 of a pattern: nothing matched yet; bit i: its first i symbols."""

    def __init__(self, patterns: list[Pattern]):
        # Masks are collected as places and made at once: thousands of patterns would else copy long numbers as often.
        at, places = 0, {}
        any_, start, loops = [], [], []
        self.ends: dict[int, int] = {}
        for n, p in enumerate(patterns):
            start.append(at)
            for i, symbol in enumerate(p.symbols):
                if symbol is None:
                    any_.append(at + i + 1)
                else:
                    for c in symbol:
                        places.setdefault(c, []).append(at + i + 1)
            # A loop holds inside its own part only: a border is no character that it reads.
            loops += [at + i for i in p.stars]
            self.ends[at + len(p.symbols)] = n
            at += len(p.symbols) + 1
        number = lambda bits: int.from_bytes(np.packbits(np.bincount(bits, minlength=at).astype(bool), bitorder="little").tobytes(), "little") if bits else 0
        self.masks = {c: number(bits) for c, bits in places.items()}
        self.any, self.start, self.loops, self.finals = number(any_), number(start), number(loops), number(list(self.ends))
        # A shift out of a pattern's last bit falls on the next one's bit 0, which no symbol's mask has.

    def run(self, host: str, path: str, query: str) -> list[int]:
        """Numbers of the patterns that fit, in order."""
        state, masks, any_, loops = self.start, self.masks, self.any, self.loops
        border = masks.get(_SEPARATOR, 0)
        for n, part in enumerate(("." + host, path, query)):
            if n:
                state = (state << 1) & border
            for c in map(ord, part):
                state = ((state << 1) & (masks.get(c, 0) | any_)) | (state & loops)
                if not state:
                    return []
        state &= self.finals
        found = []
        while state:
            bit = state & -state
            found.append(self.ends[bit.bit_length() - 1])
            state ^= bit
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    host = rest[:end]
    return (host.lower() if host.isascii() else "".join(c.lower() if c.isascii() else c for c in host)), path[:stop]


def query_of(url: str | None) -> str:
    """What stands between the path's question mark and the fragment."""
    rest = (url or "").partition("://")[2].partition("#")[0]
    return rest.partition("?")[2]


class Judge:
    """Verdicts by rules, then by globs."""

    def __init__(self, rules: Sequence[tuple[str, str]] = RULES, filters: Sequence[str] = FILTERS):
        self.rules = rules
        self.automaton = Automaton([*(rule_pattern(r) for _, r in rules), *map(glob_pattern, filters)])

    def judge(self, host: str, path: str, query: str = "") -> tuple[str | None, str]:
        fits = self.automaton.run(host, path, query)
        own = [n for n in fits if n < len(self.rules)]
        if own:
            verdict, rule = self.rules[max(own, key=lambda n: (len(self.rules[n][1]), -n))]
            return rule, verdict
        return None, "block" if fits else "allow"


def judge_of(rules: DataFrame | None = None, filters: DataFrame | None = None) -> Judge:
    """From tables: rules with columns verdict (allow or block) and rule, filters with a column glob. Nulls are left out."""
    found: list[list] = []
    for table, names in ((rules, ["verdict", "rule"]), (filters, ["glob"])):
        rows = [] if table is None else table.select(*names).dropna().distinct().orderBy(*names[::-1]).limit(MAX_PATTERNS + 1).collect()
        found.append([tuple(r) for r in rows])
    if sum(map(len, found)) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} rules and globs")
    if any(v not in ("allow", "block") for v, _ in found[0]):
        raise ValueError("a rule's verdict is allow or block")
    return Judge(RULES if rules is None else found[0], FILTERS if filters is None else [g for (g,) in found[1]])


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id", judge: Judge | None = None) -> DataFrame:
    """Per row: id, host, path, the rule that decided (or null) and the verdict."""
    judge = judge or Judge()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        urls = batch.column(1).to_pylist()
        parts = [split_url(u) for u in urls]
        verdicts = [judge.judge(*p, query_of(u)) if any(p) else (None, "allow") for u, p in zip(urls, parts, strict=True)]
        columns = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in verdicts], [v for _, v in verdicts]]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("u"))
    return map_batches(rows, run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", key)
