"""Quality rules: adaptive limits from mergeable quantile sketches per language and source.

Every rule is a whole number (a share per mille or a length in hundredths). A sketch is a histogram of such numbers in
buckets of a fixed relative width (1/64 of the value, exact below 128): adding up bucket counts merges sketches, in any
order, with the same result. From a group's sketches come its quartiles, and from these the limits: the upper quartile
plus RULES[rule] times the group's spread. No limit is fixed; all follow the data.

The spread is the interquartile range, averaged with the language's. Quartiles may coincide (most texts have no symbol at
all; a source may be copies of one text), so a spread is never taken to be finer than the rule can tell: one more
occurrence (of a symbol, a repeated line, a word of double length) in a text as short as the group's lower quartile of
words or lines, whose sketches are kept as well. The first occurrence in a text is free, as it says little in a short one.
Groups of fewer than MIN_GROUP texts take their language's limits; a group's limit is never above twice its language's, so
that a source which is junk throughout cannot vouch for itself. Only DataFrame functions are used.

Nulls: a null text has no words and fails the base rules; a null language or source counts as the empty string. Repeated
rows are judged one by one, alike. An empty table gives an empty result. Other columns of the input are kept or dropped
by name as the caller asks; internal columns start with "__q_".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import SPACE, cut, small, text_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Groups with fewer texts than this use their language's sketch.
MIN_GROUP = 50
#: Rule -> width of the fence in spreads.
RULES = {"symbols": 10, "dup_lines": 2, "word_length": 12}
#: Rule -> what its number is a share of, and by how much one more occurrence moves the number of a text with one of these.
_UNITS = {"symbols": ("n_words", "1000"), "dup_lines": ("n_lines", "1000"), "word_length": ("n_words", "__q_high_word_length")}
#: What sketches are kept of.
_SKETCHED = (*RULES, "n_words", "n_lines")
#: A table of limits is broadcast up to this many rows (about 100 bytes each); beyond, the join shuffles.
MAX_BROADCAST_ROWS = 200_000


def with_features(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with the counts the rules need, as columns __q_*.

    The five-word windows are compared by a 64-bit hash of their words; only texts in which one occurs twice are looked
    at further.
    """
    words = F.array_remove(F.split(F.col("__q_text"), f"{SPACE}+"), "")
    hashes = F.when(
        F.size("__q_words") > 5,
        F.transform(F.sequence(F.lit(0), F.size("__q_words") - 5), lambda i: F.xxhash64(*[F.get(F.col("__q_words"), i + k) for k in range(5)])),  # slice() would copy the whole array
    )
    same = lambda x, k: (F.get(F.col("__q_sorted"), k - 1)["h"] == x["h"]) | (F.get(F.col("__q_sorted"), k + 1)["h"] == x["h"])
    lines = F.filter(F.split(F.col("__q_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    covered = F.aggregate(
        F.transform(F.col("__q_at"), lambda p, k: F.least(F.lit(5), F.coalesce(F.get(F.col("__q_at"), k + 1), p + 5) - p)),
        F.lit(0),
        lambda total, x: total + x,
    )
    ratio = lambda part, whole, times: F.expr(f"({part} * {times}) div greatest({whole}, 1)")
    return (
        docs.withColumns({"__q_text": text_of(text), "__q_lang": F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")), "__q_source": F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))})
        .withColumns({"__q_words": words, "__q_lines": lines})
        .withColumns({
            "__q_n_words": F.size("__q_words").cast("long"),
            "__q_word_chars": (F.length("__q_text") - F.size(F.split("__q_text", SPACE, -1)) + 1).cast("long"),
            "__q_n_symbols": (F.size(F.split("__q_text", "[#*$%&|<>]", -1)) - 1).cast("long"),
            "__q_n_lines": F.size("__q_lines").cast("long"),
            "__q_n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
            "__q_hashes": hashes,
        })
        .drop("__q_lines", "__q_words", "__q_text")
        .withColumn("__q_sorted", F.when(F.size(F.array_distinct("__q_hashes")) < F.size("__q_hashes"), F.sort_array(F.transform("__q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .drop("__q_hashes")
        .withColumn("__q_at", F.sort_array(F.transform(F.filter("__q_sorted", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])))
        .drop("__q_sorted")
        .withColumn("__q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("__q_at")
        .withColumns({
            "__q_base_failed": (F.col("__q_n_words") < MIN_WORDS) | (100 * F.col("__q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__q_n_words")),
            "__q_symbols": ratio("greatest(__q_n_symbols - 1, 0)", "__q_n_words", 1000),
            "__q_dup_lines": ratio("greatest(__q_n_dup_lines - 1, 0)", "__q_n_lines", 1000),
            "__q_word_length": ratio("__q_word_chars", "__q_n_words", 100),
            # A filter that uses this column stays above this projection; else the optimizer would copy whole
            # expressions into it and repeat them for every element of the arrays.
            "__q_barrier": F.monotonically_increasing_id(),
        })
    )


def bucket(value: str) -> Column:
    """The lower end of value's bucket: itself below 128, else its first seven binary digits followed by zeros."""
    return F.expr(f"CASE WHEN {value} < 128 THEN {value} ELSE shiftleft(shiftright({value}, length(bin({value})) - 7), length(bin({value})) - 7) END")


def sketches(features: DataFrame) -> DataFrame:
    """Bucket counts by language, source and what they are of, from the texts that pass the base rules."""
    pairs = ", ".join(f"'{name}', __q_{name}" for name in _SKETCHED)
    return (
        features.where((F.col("__q_barrier") >= 0) & ~F.col("__q_base_failed"))
        .select("__q_lang", "__q_source", F.expr(f"stack({len(_SKETCHED)}, {pairs}) AS (__q_name, __q_value)"))
        .groupBy("__q_lang", "__q_source", "__q_name", bucket("__q_value").alias("__q_bucket"))
        .agg(F.count(F.lit(1)).alias("__q_n"))
    )


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: the number of its texts, and lower and upper quartile from each of its merged sketches."""
    group = Window.partitionBy(*by, "__q_name")
    up_to = group.orderBy("__q_bucket").rowsBetween(Window.unboundedPreceding, 0)
    quartile = lambda k: F.min(F.when(4 * F.col("__q_up_to") >= k * F.col("__q_total"), F.col("__q_bucket")))
    one = lambda name, column: F.max(F.when(F.col("__q_name") == name, F.col(column))).alias(f"{column}_{name}")
    return (
        sketch.groupBy(*by, "__q_name", "__q_bucket")
        .agg(F.sum("__q_n").alias("__q_n"))
        .withColumns({"__q_up_to": F.sum("__q_n").over(up_to), "__q_total": F.sum("__q_n").over(group)})
        .groupBy(*by, "__q_name")
        .agg(quartile(1).alias("__q_low"), quartile(3).alias("__q_high"), F.max("__q_total").alias("__q_total"))
        .groupBy(*by)
        .agg(F.max("__q_total").alias("__q_size"), *[one(name, c) for name in _SKETCHED for c in ("__q_low", "__q_high")])
    )


def limits(features: DataFrame) -> DataFrame:
    """One row per language and source with a column __q_max_<rule> for each rule."""
    sketch = cut(sketches(features))
    finest = lambda rule: F.expr(f"{_UNITS[rule][1]} div greatest(__q_low_{_UNITS[rule][0]}, 1)")
    range_ = lambda rule: F.col(f"__q_high_{rule}") - F.col(f"__q_low_{rule}")
    by_lang = quartiles(sketch, ["__q_lang"])
    spread = {rule: F.greatest(range_(rule), finest(rule)) for rule in RULES}
    by_lang = by_lang.select("__q_lang", *[s.alias(f"__q_spread_{r}") for r, s in spread.items()], *[(F.col(f"__q_high_{r}") + RULES[r] * s).alias(f"__q_fence_{r}") for r, s in spread.items()])
    both = quartiles(sketch, ["__q_lang", "__q_source"]).join(by_lang, "__q_lang")

    def limit(rule: str) -> Column:
        mean = F.floor((range_(rule) + F.col(f"__q_spread_{rule}")) / 2)
        own = F.col(f"__q_high_{rule}") + RULES[rule] * F.greatest(mean, finest(rule))
        lang = F.col(f"__q_fence_{rule}")
        return F.when(F.col("__q_size") >= MIN_GROUP, F.least(own, 2 * lang)).otherwise(lang).cast("long")

    return cut(both.select("__q_lang", "__q_source", *[limit(r).alias(f"__q_max_{r}") for r in RULES]))


def with_verdict(features: DataFrame, table: DataFrame) -> DataFrame:
    """features with __q_kept: not failed by the base rules, and within each limit of its language and source."""
    within = reduce(lambda a, b: a & b, [F.col(f"__q_{rule}") <= F.col(f"__q_max_{rule}") for rule in RULES])
    joined = features.join(small(table, MAX_BROADCAST_ROWS), ["__q_lang", "__q_source"], "left")
    return joined.withColumn("__q_kept", ~F.col("__q_base_failed") & F.coalesce(within, F.lit(False)))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The verdict on each row of docs, with the counts it rests on and the limits that were applied."""
    own = with_features(docs.select(key, text, lang, source), text, lang, source)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    features = cut(own.select(key, "__q_lang", "__q_source", "__q_base_failed", "__q_barrier", *[f"__q_{x}" for x in [*names, "n_lines", *RULES]]))
    judged = with_verdict(features, limits(features))
    return judged.select(key, *[F.col(f"__q_{x}").alias(x) for x in [*names, "base_failed", "kept"]], *[F.col(f"__q_max_{x}").alias(f"max_{x}") for x in RULES])


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept, with docs' own columns.

    The features are computed once and written beside the rows as Parquet below the shared folder, of which the limits
    read the few narrow columns only; so neither is work done twice nor are texts shuffled.
    """
    narrow = ["__q_lang", "__q_source", "__q_base_failed", "__q_barrier", *[f"__q_{x}" for x in _SKETCHED]]
    plain = [f"c{k}" for k in range(len(docs.columns))]
    folder = shared_dir(docs.sparkSession)
    features = with_features(docs, text, lang, source)
    features.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(docs.columns, plain, strict=True)], *narrow).write.parquet(folder)
    features = docs.sparkSession.read.parquet(folder)
    kept = with_verdict(features, limits(features)).where("__q_kept").select(*[F.col(p).alias(c) for c, p in zip(docs.columns, plain, strict=True)])
    kept.scratch_folder = folder  # of no use once the result is written, which only the caller knows
    return kept
