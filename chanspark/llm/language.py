"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of order 0 to ORDER is counted from a bounded sample of labelled texts and then frozen.
A byte after its context costs -log2 of n / (total + distinct) if the context has seen it, else the context's escape,
-log2 of distinct / (total + distinct), plus its cost in the next shorter context; below order 0 all 256 bytes cost 8
bits (method C, without exclusions). A text's code length in a language is the exact sum over all its bytes, the first of
them after ORDER spaces; the shortest code wins, the first name among equals. The score is the winner's share of
2^-(code length), so 1 divided by the number of languages at least.

The trees of all languages are laid out as two hash tables (whole grams, and contexts with their escapes) whose rows hold
one cost per language. Scoring is a map over Arrow batches without a shuffle.

Bounds: SAMPLE_ROWS texts and about SAMPLE_BYTES bytes for each language, whole texts chosen by a hash of their id after
removing copies; these go to the driver and the tables to every worker (about 1 MB for each language). One row for each
language is collected to set the sampling rate.

Nulls: a null text, or one without any letter, is "und" with score 0; so is every text when there is nothing to learn
from. Rows without a language or an id are never learnt from. Repeated rows are judged alike, one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

ORDER = 3
SAMPLE_ROWS = 256
SAMPLE_BYTES = 1 << 20
#: Labels that are learnt at most, the most frequent ones (then by name): a model is about 1 MB for each.
MAX_LANGS = 500
UNKNOWN = "und"
_PAD = b" " * ORDER
_LETTER = regex.compile(r"\p{L}")
#: Costs that are held at once, in bytes of text times languages.
_BLOCK = 4_000_000


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from ORDER on: it and the order bytes before it, as one number."""
    out = data[ORDER:].astype(np.uint32)
    for k in range(1, order + 1):
        out |= data[ORDER - k : len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Lookup:
    """A hash table from numbers of 32 bits to row numbers; looks up whole arrays. Missing: -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(4 * len(keys) + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint32)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slots = self.slots(keys)
        while len(left):
            free = self.rows[slots] < 0
            self.rows[slots[free]] = left[free]  # of several that want a slot, one gets it
            self.keys[slots[free]] = keys[left[free]]
            rest = self.rows[slots] != left
            left, slots = left[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self.slots(keys)
        rows = self.rows[slots]
        open_ = np.flatnonzero((rows >= 0) & (self.keys[slots] != keys))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            rows[open_] = found = self.rows[slots]
            go_on = (found >= 0) & (self.keys[slots] != keys[open_])
            open_, slots = open_[go_on], slots[go_on]
        return rows


class Model:
    """Frozen context trees of several languages."""

    def __init__(self, samples: Iterable[tuple[str, str]]):
        texts: dict[str, list[bytes]] = {}
        for lang, text in samples:
            texts.setdefault(lang, []).append(_PAD + text.encode())
        self.langs = sorted(texts)
        counted = {lang: [self.count(texts[lang], k) for k in range(ORDER + 1)] for lang in self.langs}
        self.levels: list[tuple[Lookup, np.ndarray, Lookup, np.ndarray]] = []
        for k in range(ORDER + 1):
            tables = [counted[lang][k] for lang in self.langs]
            keys = np.unique(np.concatenate([t[0] for t in tables])) if tables else np.zeros(0, np.uint32)
            contexts = np.unique(keys >> np.uint32(8)) if k else np.zeros(1, np.uint32)
            escapes = np.zeros((len(contexts) + 1, len(self.langs)), dtype=np.float32)  # the last row: an unseen context costs nothing
            costs = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
            own = [np.full(len(keys), -1.0) for _ in tables]
            for n, (grams_, counts) in enumerate(tables):
                above, at = np.unique(grams_ >> np.uint32(8) if k else np.zeros(len(grams_), np.uint32), return_inverse=True)
                distinct, total = np.bincount(at), np.bincount(at, counts)
                escapes[np.searchsorted(contexts, above), n] = -np.log2(distinct / (total + distinct))
                own[n][np.searchsorted(keys, grams_)] = -np.log2(counts / (total + distinct)[at])
            self.levels.append((Lookup(keys), costs, Lookup(contexts), escapes))
            lower = self.fallback(keys, k)
            for n in range(len(tables)):
                costs[:, n] = np.where(own[n] >= 0, own[n], lower[:, n])

    @staticmethod
    def count(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([grams(np.frombuffer(t, np.uint8), order) for t in texts]), return_counts=True)

    def fallback(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Cost of grams of order k that their context has not seen."""
        _, _, contexts, escapes = self.levels[k]
        escape = escapes[contexts.find(keys >> np.uint32(8) if k else np.zeros(len(keys), np.uint32))]
        if not k:
            return escape + np.float32(8)
        return escape + self.costs(keys & np.uint32((1 << 8 * k) - 1), k - 1)

    def costs(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits for the last byte of each gram of order k, a column for each language."""
        whole, costs, _, _ = self.levels[k]
        rows = whole.find(keys)
        missing = np.flatnonzero(rows < 0)
        if not len(costs):
            return self.fallback(keys, k)
        out = costs[rows]
        if len(missing):
            out[missing] = self.fallback(keys[missing], k)
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        step = max(1, _BLOCK // max(1, len(self.langs)))
        at = 0
        while at < len(texts):
            block, size, first = [], 0, at
            while at < len(texts) and (not block or size + len(block[-1]) <= step):
                block.append(_PAD + texts[at].encode())
                size += len(block[-1])
                at += 1
            if len(block) == 1:  # a text may be longer than a block
                data = np.frombuffer(block[0], np.uint8)
                for a in range(ORDER, len(data), step):
                    out[first] += self.costs(grams(data[a - ORDER : a + step], ORDER)).sum(axis=0, dtype=np.float64)
                continue
            data = np.frombuffer(b"".join(block), np.uint8)
            cost = self.costs(grams(data, ORDER))
            ends = np.cumsum([len(b) for b in block])
            for n, (end, b) in enumerate(zip(ends.tolist(), block, strict=True)):
                # Row i belongs to byte i + ORDER; a text's padding itself costs nothing.
                out[first + n] = cost[end - len(b) : end - ORDER].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        known = [bool(t and self.langs and _LETTER.search(t)) for t in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(known)
        if len(at):
            bits = self.lengths([texts[i] for i in at])
            best = bits.argmin(axis=1)
            with np.errstate(under="ignore"):
                scores[at] = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
            for i, b in zip(at, best, strict=True):
                names[i] = self.langs[b]
        return names, scores


def sample(labelled: DataFrame, text: str, lang: str, key: str) -> list[tuple[str, str]]:
    """The texts to learn from: at most SAMPLE_ROWS and about SAMPLE_BYTES for each of MAX_LANGS languages, at least one."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("t"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"))
    rows = rows.where("lang IS NOT NULL AND t IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return []
    rates = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, 2 * SAMPLE_ROWS / n)))])
    some = rows.where(F.col("lang").isin(*counts)).where(F.pmod("h", F.lit(1_000_000)) < rates[F.col("lang")] * 1_000_000)
    one = some.groupBy("lang", F.xxhash64("t").alias("copy")).agg(F.min_by("t", "h").alias("t"), F.min("h").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    ranked = one.withColumns({"n": F.row_number().over(order), "size": F.sum(F.octet_length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    chosen = ranked.where((F.col("n") == 1) | ((F.col("n") <= SAMPLE_ROWS) & (F.col("size") <= SAMPLE_BYTES)))
    return [(r["lang"], r["t"]) for r in chosen.orderBy("lang", "h").select("lang", "t").collect()]


def held_out(key: str) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    return Model(sample(docs.where(~held_out(key) & F.col(f"`{key}`").isNotNull()), text, lang, key))


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: id, held_out, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, scores = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("id"), held_out(key).alias("held_out"), F.col(f"`{text}`").cast("string").alias("t"))
    return map_arrow(rows, run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", key)
