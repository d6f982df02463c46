"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Plain ball hashing for radius 4 has every fingerprint emit its 2081 variants within 2 bits; two fingerprints within 4
bits share one of them. Here the radius is first cut down by leaving out a third of the bits: of the three blocks of 21,
21 and 22 bits, one holds at least two of any four differing bits and at least one of any three, so with that block left
out the remaining 42 or 43 bits differ in 2 bits at most, and variants within half of that (1 bit) meet. So a fingerprint emits
43 or 44 variants for each of three masks, 131 in all; pairs that meet are then verified on all 64 bits. Keys of 42 bits
leave about one chance meeting in 10^10 pairs, so buckets hold near copies and little else.

A bucket is never expanded into pairs: each gives a spanning forest of its links, at most one edge for each member.
Components come from alternating large-star and small-star steps, each cut by a checkpoint; nothing is collected.

Nulls and ties: a null text has no words, hence fingerprint zero, linked like any other. Repeated rows get the same
fingerprint and component. A null id never names a component; a component without any id has a null name. An empty table
gives an empty result. The graph's nodes are the distinct fingerprints, so ids may repeat or be missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, map_batches, small, text_of

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Components of more than one node, or nodes (16 bytes each), that are broadcast at most; beyond, joins shuffle.
MAX_COMPONENTS = 1_000_000
_BLOCKS = [range(0, 21), range(21, 42), range(42, 64)]
#: For each mask: the bits that are kept, and the variants to XOR in (none, or one kept bit).
_MASKS = [np.uint64(sum(1 << b for b in range(64) if b not in block)) for block in _BLOCKS]
_FLIPS = [np.array([0, *(1 << b for b in range(64) if b not in block)], dtype=np.uint64) for block in _BLOCKS]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of that many words, in order (of all words if there are fewer)."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return np.array([], dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash: bit i is set if it is set in over half the shingles' XXH64."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """Of 64-bit hashes, the bits that are set in over half."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 65536):  # the bits of a very long text are counted in parts
        counts += np.unpackbits(hashes[part : part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Id, hash of the text, and fingerprint (as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["id", "text_hash", "fp"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), _text_hash(text).alias("text_hash"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_batches(rows, run, "id long, text_hash long, fp long")


def _orderable(docs: DataFrame, column: str) -> Column:
    """A column, or its JSON where values of its type have no order."""
    return F.to_json(F.array(F.col(f"`{column}`"))) if any(x in docs.schema[column].dataType.simpleString() for x in ("map<", "variant")) else F.col(f"`{column}`")


def _text_hash(text: str) -> Column:
    return F.xxhash64(text_of(text))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint: a row for every mask and variant; the mask's number stands in the bits that it leaves out."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            fp = batch.column(0).to_numpy().view(np.uint64)
            for n, (mask, flips) in enumerate(zip(_MASKS, _FLIPS, strict=True)):
                kept = (fp & mask)[:, None] ^ flips[None, :]
                # The left-out block is zero now; its lowest bits make room for the mask's number.
                keys = (kept | np.uint64((n + 1) << _BLOCKS[n].start)).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fp.view(np.int64), len(flips)))], names=["key", "fp"])


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the members of a bucket exactly as its links do: breadth first, over those not reached yet."""
    edges, left = [], np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= RADIUS
            if near.any():
                reached, left = left[near], left[~near]
                edges += [(int(x), int(y)) for y in reached]
                queue += reached.tolist()
    return edges


def whole_buckets(batches: Iterator[pa.RecordBatch], below: int = 0) -> Iterator[list[np.ndarray]]:
    """Keys and other columns (unsigned) of a partition sorted by key, cut between buckets. Holds one bucket and one batch at a time.

    below: so many low bits of a key do not tell buckets apart."""
    held: list[list[np.ndarray]] = []  # batches that have not been closed yet; all but the last are of one bucket
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(0).to_numpy(), *[c.to_numpy().view(np.uint64) for c in batch.columns[1:]]])
        if held[0][0][0] >> below == held[-1][0][-1] >> below:
            continue  # one bucket so far
        key, *others = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = int(np.searchsorted(key, key[-1] >> below << below, side="left"))  # the last bucket may go on in the next batch
        yield [key[:last], *[x[:last] for x in others]]
        held = [[key[last:].copy(), *[x[last:].copy() for x in others]]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of the buckets of a partition sorted by key."""
    for key, fp in whole_buckets(batches):
        own = fp.view(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        a, b = [own[two]], [own[two + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if edges := _forest(fp[s : s + n]):
                x, y = np.array(edges, dtype=np.int64).T + s
                a.append(own[x]), b.append(own[y])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """Node -> smallest node of its component, for undirected edges (a, b), a != b; nodes without an edge have no row.

    Large-star and small-star in turn (Kiveris et al., 2014) until the edges are stars around the smallest nodes. A
    node's neighbours are only ever reduced to their minimum, so hubs cost partial aggregates; the join that hands the
    minimum back is one that adaptive execution splits where a hub makes it skewed.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while (now := state(edges)) != before:
        before = now
        if not now[0]:
            break
        # There are two nodes for an edge at most; so few are broadcast, and a hub is no hot key of a join.
        hand = F.broadcast if 2 * now[0] <= MAX_COMPONENTS else lambda x: x
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = cut(both.join(hand(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), now[0])
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        lesser = edges.join(hand(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", F.col("m").alias("b")))
        edges = cut(lesser.distinct(), 2 * now[0])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(prints: DataFrame) -> DataFrame:
    """Adds to rows with id and fp the smallest id reachable over links, and the component's own number, a fingerprint."""
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))  # copies meet before anything is expanded
    spread = map_arrow(nodes.select("fp"), _variants, "key long, fp long")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = map_arrow(spread.repartition(parts, "key").sortWithinPartitions("key"), _links, "a long, b long")
    return named(prints, nodes, connected(edges))


def named(prints: DataFrame, nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """prints with the smallest id of each row's component and the component's number; nodes: fp and its smallest id."""
    roots = stars.union(stars.select("root", "root").distinct())
    least = cut(roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("rep").alias("least")))
    linked = roots.join(small(least, MAX_COMPONENTS), "root")  # by a broadcast, so a component of many nodes is no hot key
    names = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", F.coalesce("least", "rep").alias("component_id"), F.coalesce("root", "fp").alias("component"))
    names = cut(names)  # so both sides of the last join are plain exchanges, which adaptive execution splits where copies make a key hot
    return prints.join(names, "fp", "left")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: its id, fingerprint as 16 hexadecimal digits, and component."""
    found = components(cut(fingerprints(docs, text, key)))
    return found.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component with docs' own columns: the one of the smallest id, a row without id only where there is
    no other; of rows alike in that the one whose text has the smallest hash; of rows alike in both the smallest one by its
    other columns, in their order."""
    return one_of_each(docs, components(cut(fingerprints(docs, text, key))), text, key)


def one_of_each(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """keep_one for components that are found already (id, text_hash, component)."""
    rows = found.groupBy("component", "id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "copies")).alias("k")
    kept = cut(rows.groupBy("component").agg(best).select(F.col("k.id").alias("__s_id"), F.col("k.text_hash").alias("__s_hash"), F.col("k.copies").alias("__s_copies")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    chosen = lambda some: docs.join(some, F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__s_id")) & (_text_hash(text) == F.col("__s_hash")), "left_semi")
    if kept.where("__s_copies > 1").isEmpty():
        return chosen(kept)
    # Rows that occur more than once, id and text alike: these alone are grouped, with partial aggregates.
    repeated = chosen(kept.where("__s_copies > 1")).groupBy(F.col(f"`{key}`").alias("__s_id"), _text_hash(text).alias("__s_hash")).agg(F.min_by(F.struct(*own), F.struct(*[_orderable(docs, c) for c in docs.columns])).alias("__s_row"))
    return chosen(kept.where("__s_copies = 1")).unionByName(repeated.select("__s_row.*"))
