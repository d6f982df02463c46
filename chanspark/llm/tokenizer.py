"""Token counts and token ids by way of distinct chunks.

A chunk is a stretch of text that a tokenizer treats on its own: for both vocabularies here, a single space between two
characters that are no white space always begins a new one. Counting (or encoding) each distinct chunk once and joining
that to a document's chunk frequencies gives exactly what the library gives for the whole text.

Counting does so by tables. A first pass over the texts finds the words that recur; the most frequent, MAX_HEAD at most,
are counted once each and broadcast, so their frequencies are joined where the texts are and no word is a hot key of a
shuffle. A second pass gives each document's words with their frequencies. The pairs with all other words are shuffled by
word; there each distinct word is counted once and joined to its frequencies, and the sums go back by document. No ids are
made. Words of more than MAX_CHUNK characters are counted where they stand, as they hardly ever recur.

Ids (for packing) come from the tiktoken library, which reads the same merges as ranks and is several times as fast as the
tokenizers library; they are the latter's ids, special strings included, which stand for their own ids there.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Words that are broadcast at most, with their counts (about 150 bytes each in a worker).
MAX_HEAD = 200_000
#: Longest word (in characters) that is shuffled or broadcast.
MAX_CHUNK = 48
#: Texts (by characters) that are looked at together.
BLOCK_CHARS = 2_000_000


def default_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PieceCounter:
    """Counts sentencepiece tokens.

    The model adds one space in front of a text and turns spaces into U+2581; no piece of its vocabulary holds that
    character after any other, so no merge crosses from a word into the spaces after it. Words are therefore the texts
    between single spaces, each with its space in front - which the library adds itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a", out_type=str)[0].startswith("▁")

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of words as words() gives them; the empty one is a space at the end of a text, with no word of its own."""
        counts = self.count(words)
        if "" in words:
            counts = [c if w else len(self.model.encode("a ")) - len(self.model.encode("a")) for w, c in zip(words, counts, strict=True)]
        return counts

    @staticmethod
    def words(text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or "▁" in text:
            # Runs of spaces stay with the word after them; a literal U+2581 counts as a space.
            return [w[1:] for w in re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁"))]
        return text.split(" ")


#: The split of byte-level BPE as the tokenizers library has it: fixed by the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteEncoder:
    """Ids of a byte-level BPE as little-endian 32-bit strings, equal to the tokenizers library's."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        model, split = own["model"], own["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        extra = {t["content"]: t["id"] for t in own["added_tokens"]}
        simple = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in own["added_tokens"])
        # Merges have to be in the order of their ids, as ranks are.
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if not plain or not simple or own["normalizer"] or own["post_processor"] or own["truncation"] or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if token not in extra}
        self.model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.extra = {t: np.array([n], dtype="<u4").tobytes() for t, n in extra.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(extra, key=len, reverse=True))) + ")") if extra else None

    def ids(self, text: str) -> bytes:
        return self.model.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [self.ids(t) if self.cut is None or not self.cut.search(t) else b"".join(self.extra.get(p) or self.ids(p) for p in self.cut.split(t)) for t in texts]


_LOADED: dict[tuple[type, str], PieceCounter | ByteEncoder] = {}


def load(kind: type, path: str):
    """One instance for each worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    """texts in stretches of about BLOCK_CHARS characters, null as the empty text."""
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _piece_words(texts: list[str]) -> Iterator[Counter]:
    """The words of each text and how often they occur."""
    return (Counter(PieceCounter.words(t)) for t in texts)


def recurring(texts: DataFrame) -> DataFrame:
    """Words of up to MAX_CHUNK characters of a column t that two texts of a block share, and how many texts of such blocks have
    them. What is missed is rare: it is in one text of a block at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist()):
                found: Counter = Counter()
                for words in _piece_words(block):
                    found.update(words.keys())
                shared = [w for w, n in found.items() if n > 1 and len(w) <= MAX_CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(shared, pa.string()), pa.array([found[w] for w in shared], pa.int64())], names=["word", "texts"])

    return map_arrow(texts.select("t"), run, "word string, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))


def most_frequent(words: DataFrame) -> list[str]:
    """The words that are in the most texts, MAX_HEAD at most: all that are in at least a power of two of texts, for the
    least power that keeps the bound."""
    power = F.floor(F.log2("texts")).cast("int")
    sizes = {r["p"]: r["n"] for r in words.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 at most
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > MAX_HEAD:
            break
        least = p
    return [r["word"] for r in words.where(power >= least).select("word").collect()]


def frequencies(texts: DataFrame, known: Broadcast, path: str) -> DataFrame:
    """For each row (row, id, n_bytes, t): one row without a word, with the tokens of its known and long words, and one for
    each other word, with its frequency n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, head = load(PieceCounter, path), known.value
        for batch in batches:
            at, row_ids, (row, key, size, _) = 0, batch.column(0).to_pylist(), [f.type for f in batch.schema]
            for block in blocks(batch.column(3).to_pylist()):
                tokens, rows, words, counts = [], [], [], []
                for k, found in enumerate(_piece_words(block), at):
                    total = 0
                    for w, n in found.items():
                        if w in head:
                            total += n * head[w]
                        elif len(w) > MAX_CHUNK:
                            total += n * counter.count_words([w])[0]
                        else:
                            rows.append(row_ids[k]), words.append(w), counts.append(n)
                    tokens.append(total)
                own = batch.slice(at, len(block))
                at += len(block)
                columns = [own.column(0), own.column(1), own.column(2), pa.array(tokens, pa.int64()), pa.nulls(len(block), pa.string()), pa.nulls(len(block), pa.int64())]
                others = [pa.array(rows, row), pa.nulls(len(rows), key), pa.nulls(len(rows), size), pa.nulls(len(rows), pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())]
                for some in (columns, others):
                    yield pa.RecordBatch.from_arrays(some, names=["row", "id", "n_bytes", "tokens", "word", "n"])

    return map_arrow(texts.select("row", "id", "n_bytes", "t"), run, f"row long, id {texts.schema['id'].dataType.simpleString()}, n_bytes long, tokens long, word string, n long")


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, limit: int = 4096) -> DataFrame:
    """Per row: id, UTF-8 bytes, sentencepiece tokens, and whether these exceed the limit.

    A null or empty text has no bytes and no tokens. Repeated rows are counted one by one.
    """
    path = path or default_path("piece_bpe_32k.model")
    counter = load(PieceCounter, path)
    whole = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("n_bytes", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(PieceCounter, path)
        for batch in batches:
            # Sorted by word: each is counted once, or twice where a batch ends within its rows.
            words = batch.column(4).dictionary_encode()
            n = counter.count_words(words.dictionary.to_pylist())
            pieces = pa.array(n, pa.int64()).take(words.indices)
            tokens = pc.if_else(pc.is_null(words), batch.column(3), pc.multiply(pieces, batch.column(5)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], tokens], names=["row", "id", "n_bytes", "tokens"])

    if counter.splits:
        head = most_frequent(cut(recurring(whole)))
        known = docs.sparkSession.sparkContext.broadcast(dict(zip(head, counter.count_words(head), strict=True)))
        # A number for each row, as ids may repeat. It holds from here to the sum; rows without a word are spread by it.
        pairs = frequencies(whole.withColumn("row", F.monotonically_increasing_id()), known, path)
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = pairs.repartition(parts, F.coalesce("word", F.col("row").cast("string"))).sortWithinPartitions("word")
        kind = whole.schema["id"].dataType.simpleString()
        summed = map_arrow(pairs, count, f"row long, id {kind}, n_bytes long, tokens long")
        counted = summed.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    else:  # a vocabulary whose pieces reach across words
        counted = _whole(whole, path)
    return counted.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _whole(texts: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(PieceCounter, path)
        for batch in batches:
            n = [c for block in blocks(batch.column(1).to_pylist()) for c in counter.count(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts, run, f"id {kind}, n_bytes long, n_tokens long")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
