"""Benchmark decontamination: a prefix-filtered set join of documents and item windows.

A window is ten consecutive words of an item (all of them if there are fewer). Its tokens are its shingles of five words
(fewer in a shorter window), and a document holds the window only if it holds all of them; so under any order of tokens
the first one, the prefix, is necessary. Tokens are ordered by rarity over the benchmark's windows, so each window is
looked up by its rarest shingle. A document's shingles meet those prefix tokens by a 64-bit hash of words whose A-Z (only)
are in lower case, on both sides before the split, as full lower case depends on a letter's neighbours (capital sigma);
positional and length bounds (the window has to lie inside the document at the offset that the shingle has in it) and the
exact comparison of its words decide.

The prefix tokens come from the benchmark alone. Up to MAX_TOKENS of them, counted first, are tested inside each row, so
that only meetings leave it. Beyond that, shingles are joined with them as (id, hashes, position), without any words: a
semi join that broadcasts up to MAX_BROADCAST_TOKENS and shuffles above; what it finds is folded per document and joined
back to the texts. From there on both ways are one: a document's few candidates are joined with the windows, with the
words around them, and folded per document. Only DataFrame functions are used; nothing is collected but the tokens below
the first bound.

Nulls: a null text (or item text) has no words. Repeated documents each get their row; documents with the same id and
text are folded as one and written out as often as they occur. Repeated items count once for each id; items without an
id are left out of n_items and items_sha256, though their windows hit. Without benchmark rows nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, text_of

WINDOW = 10
SHINGLE = 5
MAX_TOKENS = 50_000
#: Prefix tokens (12 bytes each) that are broadcast at most where they are joined.
MAX_BROADCAST_TOKENS = 1_000_000
#: Documents with candidates (an id, a hash and a few positions each) that are broadcast at most to be joined back.
MAX_BROADCAST_MET = 200_000
#: Windows that are broadcast at most (about 250 bytes each).
MAX_BROADCAST_WINDOWS = 200_000
#: Ids of contaminated documents that are broadcast at most; beyond, the join shuffles.
MAX_DIRTY = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, in texts whose A-Z are still there or are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words with A-Z (only) in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def _hash(words: Column, at: Column, size: int) -> Column:
    """Hash of the words at, at + 1, ..."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def item_windows(items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per distinct window: its words, item ids, size of the chosen shingle, that shingle's offset and hash."""
    words = items.select(F.col(f"`{key}`").cast("string").alias("item"), _words(text_of(text)).alias("w")).where(F.size("w") > 0)
    wide = words.withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))))
    wide = wide.select("item", F.slice("w", F.col("first") + 1, window).alias("words"))
    wide = wide.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))  # distinct ids of one benchmark text
    tokens = []
    for k in range(1, shingle + 1):
        fits = F.size("words") >= k if k == shingle else F.size("words") == k
        tokens.append(wide.where(fits).select("words", "items", F.lit(k).alias("k"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - k), _hasher(F.col("words"), k))).alias("offset", "hash")))
    every = tokens[0]
    for t in tokens[1:]:
        every = every.union(t)
    rarity = every.groupBy("k", "hash").agg(F.count(F.lit(1)).alias("n"))
    ranked = every.join(rarity, ["k", "hash"]).withColumn("rank", F.row_number().over(Window.partitionBy("words").orderBy("n", "hash", "offset")))
    return ranked.where("rank = 1").select("words", "items", "k", "offset", "hash")


def hits(docs: DataFrame, windows: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Per row of docs: id, number of words, and its hits as an array of (first word, number of words, item ids)."""
    sizes = windows.groupBy("k").agg(F.count_distinct("hash").alias("n")).collect()  # one row per shingle size, five at most
    tested = sum(r["n"] for r in sizes) <= MAX_TOKENS
    base = docs.select(F.col(f"`{key}`").alias("id"), text_of(text).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    base = base.withColumn("w", _words(F.col("t"))).drop("t")
    found = []
    w = F.col("w")
    kind = "array<struct<k:int,at:int,h:bigint>>"
    spread = base
    for k in sorted(r["k"] for r in sizes):
        at = F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), _token(w, k)))
        spread = spread.withColumn(f"tokens_{k}", at)
        listed = _listed(f"tokens_{k}", [r["hash"] for r in windows.where(F.col("k") == k).select("hash").distinct().collect()]) if tested else F.col(f"tokens_{k}")
        found.append(F.coalesce(listed, F.array().cast(kind)))
    spread = spread.withColumn("c", F.concat(*found) if found else F.array().cast(kind))
    if not tested:
        spread = _joined(base, spread, windows)
    # Every document has a row without a candidate, which brings it through the joins.
    spread = spread.withColumn("c", F.concat(F.array(F.lit(None).cast("struct<k:int,at:int,h:bigint>")), "c"))
    # A candidate takes the words around it along, not the whole text: no window reaches further than this.
    reach = window - 1
    around = F.transform("c", lambda x: F.struct(
        x["k"].alias("k"), x["at"].alias("at"), x["h"].alias("h"), F.greatest(x["at"] - reach, F.lit(0)).alias("from"),
        F.when(x.isNotNull(), F.transform(F.sequence(F.greatest(x["at"] - reach, F.lit(0)), F.least(x["at"] + reach, F.size("w") - 1)), lambda j: F.get(F.col("w"), j))).alias("near"),
    ))
    rows = spread.select("id", "text_hash", F.size("w").cast("long").alias("n_words"), F.explode(around).alias("c"))
    # Rows without a candidate get keys of their own (of size 0, which no window has), not all the same null.
    rows = rows.select("id", "text_hash", "n_words", "c.*", F.coalesce("c.k", F.lit(0)).alias("jk"), F.coalesce("c.h", F.xxhash64("id", "text_hash")).alias("jh"))
    sides = windows.select(F.col("k").alias("wk"), F.col("hash").alias("wh"), "offset", "words", "items")
    met = rows.join(small(sides, MAX_BROADCAST_WINDOWS), (F.col("jk") == F.col("wk")) & (F.col("jh") == F.col("wh")), "left")
    first = F.col("at") - F.col("offset")
    fits = (first >= 0) & (first + F.size("words") <= F.col("n_words"))
    same = F.slice("near", F.greatest(first - F.col("from") + 1, F.lit(1)), F.size("words")) == F.col("words")
    met = met.withColumn("hit", F.when(fits & same, F.struct(first.alias("first"), F.size("words").alias("size"), F.col("items").alias("items"))))
    # Candidates that turned out wrong add nothing; every row of docs has the one row that comes without a candidate.
    met = met.where(F.col("hit").isNotNull() | F.col("k").isNull())
    folded = met.groupBy("id", "text_hash", "n_words").agg(F.sum(F.col("k").isNull().cast("int")).alias("copies"), F.sort_array(F.collect_set("hit")).alias("hits"))
    return folded.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "id", "text_hash", "n_words", "hits").select(F.col("id").alias(key), "text_hash", "n_words", "hits")


def _joined(base: DataFrame, spread: DataFrame, windows: DataFrame) -> DataFrame:
    """base with each document's shingles that are prefix tokens as an array c, by joins instead of a list."""
    tokens = windows.select(F.col("k").alias("wk"), F.col("hash").alias("wh")).distinct()
    # Outer, as the optimizer would else test the arrays' size below the projection of the words, which it copies into the
    # test and so splits the text again for every element.
    every = spread.select("id", "text_hash", F.explode_outer("c").alias("x")).where("x IS NOT NULL").select("id", "text_hash", "x.*")
    met = every.join(small(tokens, MAX_BROADCAST_TOKENS), (F.col("k") == F.col("wk")) & (F.col("h") == F.col("wh")), "left_semi")
    # Copies with one id find the same; a set keeps each once.
    met = cut(met.groupBy(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(F.collect_set(F.struct("k", "at", "h")).alias("c")))
    whole = base.join(small(met, MAX_BROADCAST_MET), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    return whole.select(*base.columns, F.coalesce("c", F.array().cast("array<struct<k:int,at:int,h:bigint>>")).alias("c"))


def _hasher(words: Column, size: int):
    return lambda i: _hash(words, i, size)


def _token(words: Column, size: int):
    return lambda i: F.struct(F.lit(size).alias("k"), i.alias("at"), _hash(words, i, size).alias("h"))


def _listed(tokens: str, hashes: list[int]) -> Column:
    """The tokens whose hash is one of these. As text, since handing thousands of literals over one by one takes seconds;
    the optimizer makes one set of them."""
    return F.expr(f"filter({tokens}, x -> x.h IN ({', '.join(f'{h}L' if h > -(1 << 63) else 'long(-9223372036854775807L - 1L)' for h in hashes)}))")


def summary(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the hits of each document."""
    # Windows in order of their first word; each adds the words behind the furthest end so far.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["first"] + x["size"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["first"] + x["size"] - F.greatest(s["end"], x["first"]))).alias("n"))
    n_hit = F.aggregate("hits", start, step, lambda s: s["n"]).cast("long")
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    keep = [c for c in found.columns if c != "hits"]
    wide = found.select(*keep, n_hit.alias("n_hit"), ids.alias("item_ids"))
    return wide.select(*keep, "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Per row of docs, how much of it stands in the benchmark and from how many items."""
    return summary(hits(docs, cut(item_windows(items, item_text, item_key)), text, key).drop("text_hash"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that hold no window of an item, with docs' own columns."""
    found = hits(docs, cut(item_windows(items)), text, key).where(F.size("hits") > 0)
    dirty = cut(found.select(F.col(f"`{key}`").alias("__c_id"), F.col("text_hash").alias("__c_hash")).distinct())
    return docs.join(small(dirty, MAX_DIRTY), F.col(f"`{key}`").eqNullSafe(F.col("__c_id")) & (F.xxhash64(text_of(text)) == F.col("__c_hash")), "left_anti")
