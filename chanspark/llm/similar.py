"""Near copies by Jaccard similarity: texts that share SIMILARITY of their distinct shingles of SHINGLE words.

Candidates are found by SimHash and meet-in-the-middle ball hashing alone, with wider balls than in simhash: at a
similarity of 0.8 some 15 of 100 bits differ, so ten of 64, where one ball of 64 bits that can be hashed ends at four. So
each set has a SimHash of 1232 bits, of which each of MASKS masks keeps KEPT, as simhash's masks leave blocks out. Under a
mask a set emits its bits and its variants, in which the FLIPS bits that are least certain (those whose sum is nearest to
a change) are flipped in all ways; two sets meet where each differing bit is one of these on either side, up to four bits
in all. The sums are of numbers from 0 to 15 made of a shingle's hash rather than of single bits, so that few shingles
have certain and less certain bits, too. Those that meet are compared on 98 further bits that travel with the key and have
to differ in REACH at most. A mask joins a pair at 0.8 with a chance of about 0.16 to 0.19 (simulated, 4 to 800 common
shingles), so a pair at 0.8 is missed with a chance of 1 to 4 in 100,000, less above.

Meetings are never expanded into pairs; all that is kept of them is which sets they join into groups. Many texts that are
much alike meet under most masks, so the first masks go first, and under the others a set goes by the name of the group
that it is in already (at first by its plain SimHash): there only meetings of different groups leave a task. Each set is then sent once to its group,
where all members are compared on their whole sets of shingles (64-bit hashes), so no pair below the threshold is linked
and links that no mask showed are found, too. Groups of more than TILE shingles are cut into tiles, and every two tiles
are compared by a task.

Nulls and ties are as in simhash: texts without words are copies of each other, and of a component the row of the
smallest id is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, map_batches, small, text_of
from .simhash import MAX_COMPONENTS, SEED, connected, majority, named, one_of_each, shingle_hashes, whole_buckets

SHINGLE = 5
#: The threshold as a fraction, so that it is compared in whole numbers.
SIMILARITY = (4, 5)
#: Masks, bits that each keeps, and of these the least certain ones, which are flipped in all ways (so 2**FLIPS variants).
MASKS = 56
KEPT = 22
FLIPS = 2
#: Masks of the first round, whose groups the others start from.
FIRST = 8
#: Further bits below each key, and of these and 64 others those that may differ where two texts meet.
FURTHER = 34
REACH = 26
#: Buckets of so many variants at most are compared pair by pair and all at once, larger ones breadth first.
FEW = 16
#: Shingles that the sets of a tile have together, about.
TILE = 1_000_000
#: Texts (a hash and some numbers each) that are broadcast at most to fetch the texts of groups; beyond, the join shuffles.
MAX_CANDIDATES = 1_000_000

#: Words of 16 numbers from 0 to 15, a number for each bit, that are made of a shingle's hash.
_WORDS = -(-MASKS * KEPT // 16)
_RANDOM = np.random.default_rng(SEED)
_FACTORS, _MIX = _RANDOM.integers(0, 1 << 63, size=(2, _WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x000F000F000F000F)
_KEPT = np.uint64((1 << KEPT) - 1)
_FURTHER = np.uint64((1 << FURTHER) - 1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def margins(shingles: np.ndarray) -> np.ndarray:
    """How far each bit of the wide SimHash is from changing, and to which side: its numbers' sum less half the most they can be, twice."""
    sums = np.zeros(16 * _WORDS, dtype=np.int64)
    for at in range(0, len(shingles), 256):  # so few that 16 bits hold a sum
        words = shingles[at : at + 256, None] * _FACTORS
        words ^= words >> np.uint64(32)
        words *= _MIX
        words ^= words >> np.uint64(29)
        sums += np.concatenate([((words >> np.uint64(shift)) & _LANES).sum(axis=0).view("<u2") for shift in (0, 4, 8, 12)])
    return 2 * sums - 15 * len(shingles)


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """For each set: under each mask the kept bits and, above them, the places of the least certain ones (5 bits each)."""
    masked = np.array([margins(s)[: MASKS * KEPT] for s in sets], dtype=np.int64).reshape(len(sets), MASKS, KEPT)
    cells = ((masked > 0) << np.arange(KEPT)).sum(axis=2)
    least = np.argpartition(np.abs(masked), FLIPS - 1, axis=2)[:, :, :FLIPS]
    return (cells | (least << (KEPT + 5 * np.arange(FLIPS))).sum(axis=2)).astype("<u4")


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of sizes a and b with so many common members reach the threshold."""
    part, whole = SIMILARITY
    return whole * common >= part * (a + b - common)


def _prints(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Id, hash of the text, number of its set of shingles (fp), the set's size and SimHash (null if empty), and wide_prints of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [_printed(batch.column(2).slice(at, 500).to_pylist()) for at in range(0, batch.num_rows, 500)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.concat_arrays(x) for x in zip(*parts, strict=True)]], names=["id", "text_hash", "fp", "size", "simhash", "cells"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(text_of(text)).alias("text_hash"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_batches(rows, run, "id long, text_hash long, fp long, size long, simhash long, cells binary")


def _printed(texts: list[str | None]) -> list[pa.Array]:
    sets = [shingle_set(t) for t in texts]
    numbers = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
    simhash = pa.array(np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64), mask=np.array([not len(s) for s in sets], dtype=bool))
    return [pa.array(numbers), pa.array([len(s) for s in sets], pa.int64()), simhash, pa.array([c.tobytes() for c in wide_prints(sets)], pa.binary())]


def _wide_variants(masks: slice) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each print (cells, name): a row for every variant under these masks, with further bits below the key.

    Further bits are those that the masks behind the row's own keep, so each mask judges meetings by other ones. In the
    first round a set's name is its SimHash, which serves for 64 of them; later 64 more of the bits go with a group's name.
    """
    ways = np.arange(1 << FLIPS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                wide = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4").reshape(-1, MASKS).astype(np.uint64)
                cells, bits = wide[:, masks, None], [np.roll(wide & _KEPT, -k, axis=1)[:, masks, None] for k in range(6)]
                flips = np.zeros((*cells.shape[:2], len(ways)), dtype=np.uint64)
                for k in range(FLIPS):
                    flips |= (ways >> np.uint64(k) & np.uint64(1)) << (cells >> np.uint64(KEPT + 5 * k) & np.uint64(31))
                keys = (bits[0] ^ flips) | (np.arange(MASKS, dtype=np.uint64)[masks] << np.uint64(KEPT))[:, None]
                keys = keys << np.uint64(FURTHER) | (bits[1] | bits[2] << np.uint64(KEPT)) & _FURTHER
                columns = [keys, np.broadcast_to(batch.column(1).to_numpy()[:, None, None], keys.shape)]
                if masks.start:
                    columns.insert(1, np.broadcast_to(bits[3] | bits[4] << np.uint64(KEPT) | bits[5] << np.uint64(2 * KEPT), keys.shape))
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel().view(np.int64)) for c in columns], names=["key", "bits", "name"] if masks.start else ["key", "name"])

    return run


def _near(a: np.ndarray, b: np.ndarray, further_a: np.ndarray, further_b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) + np.bitwise_count((further_a ^ further_b) & _FURTHER) <= REACH


def _groups(fp: np.ndarray, further: np.ndarray) -> list[np.ndarray]:
    """The members of a bucket as its links join them: breadth first, over those not reached yet."""
    found, left = [], np.arange(len(fp))
    while len(left):
        group, left = [left[0]], left[1:]
        for x in group:
            near = _near(fp[left], fp[x], further[left], further[x])
            if near.any():
                group += left[near].tolist()
                left = left[~near]
        found.append(np.array(group))
    return found


def _stars(edges: np.ndarray) -> np.ndarray:
    """For each node of these edges: the least one of its component, and itself."""
    nodes, ids = np.unique(edges, return_inverse=True)
    a, b = ids.reshape(-1, 2).T
    least, before = np.arange(len(nodes)), None
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, least[a], least[b])
        np.minimum.at(least, least[b], least[a])
        least = least[least]
    return np.stack([nodes[least], nodes], axis=1)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names that a partition's meetings join, each (simhash) under the least one of its component (key).

    Rows are those of _wide_variants. Holds a row for each name that has met another one, and one bucket and one batch."""
    found, more = np.empty((0, 2), dtype=np.uint64), []
    for key, bits, *names in whole_buckets(batches, FURTHER):
        name = names[0] if names else bits
        own, key = key.view(np.uint64), key >> FURTHER
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        few = np.repeat(sizes <= FEW, sizes)
        for step in range(1, FEW):
            x = np.flatnonzero((key[step:] == key[:-step]) & few[step:])
            if not len(x):
                break
            x = x[name[x] != name[x + step]]
            x = x[_near(bits[x], bits[x + step], own[x], own[x + step])]
            more.append(np.stack([name[x], name[x + step]], axis=1))
        for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            if (name[s : s + n] != name[s]).any():
                for g in _groups(bits[s : s + n], own[s : s + n]):
                    more.append(np.stack([np.full(len(g), name[s + g[0]]), name[s + g]], axis=1))
                    more[-1] = more[-1][more[-1][:, 0] != more[-1][:, 1]]
        if sum(map(len, more)) > max(100_000, len(found)):
            found, more = _stars(np.concatenate([found, *more])), []
    found = _stars(np.concatenate([found, *more]))
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array(found[:, k].copy().view(np.int64)) for k in (0, 1)], names=["key", "simhash"])


def meetings(prints: DataFrame) -> DataFrame:
    """Sets that have a word, by the groups that meetings of their variants join them into: fp, size, hash of a text, name of the group."""
    first = [F.first(c).alias(c) for c in ("size", "simhash", "cells")]
    own = cut(prints.where("simhash IS NOT NULL").groupBy("fp").agg(F.min("text_hash").alias("c_hash"), *first)).withColumnRenamed("simhash", "name")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for masks, columns in ((slice(0, FIRST), "key long, name long"), (slice(FIRST, MASKS), "key long, bits long, name long")):
        spread = map_arrow(own.select("cells", "name"), _wide_variants(masks), columns)
        met = map_arrow(spread.repartition(parts, F.shiftright("key", FURTHER)).sortWithinPartitions("key"), _met, "key long, simhash long")
        stars = small(connected(met.where("key != simhash").select(F.col("key").alias("a"), F.col("simhash").alias("b"))), MAX_COMPONENTS)
        own = own.join(stars, F.col("name") == F.col("node"), "left").withColumn("name", F.coalesce("root", "name")).drop("node", "root")
    return own.select("fp", "size", "c_hash", "name")


def forest(sets: list[np.ndarray], groups: list[int]) -> list[tuple[int, int]]:
    """Edges between members of different groups that join these exactly as all links between members would."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    _, own, counts = np.unique(groups, return_inverse=True, return_counts=True)
    edges, group, marked = [], own.copy(), np.zeros(len(values), dtype=bool)
    for x in np.flatnonzero(own != counts.argmax()):
        other = group != group[x]
        if not other.any():
            break
        mine = ids[starts[x] : starts[x] + sizes[x]]
        marked[mine] = True
        common = np.add.reduceat(marked[ids], starts, dtype=np.int64)
        marked[mine] = False
        for y in np.flatnonzero(other & alike(common, sizes, sizes[x])):
            if group[y] != group[x]:
                edges.append((int(x), int(y)))
                group[group == group[y]] = group[x]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of the blocks (block, fp, text) of a partition sorted by block. Holds one block and one batch at a time."""

    def close(fp: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array([(fp[x], fp[y]) for x, y in forest(sets, list(range(len(fp))))], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in (0, 1)], names=["a", "b"])

    last, fps, sets = None, [], []
    for batch in batches:
        for block, fp, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if block != last and fps:
                yield close(fps, sets)
                fps, sets = [], []
            last = block
            fps.append(fp)
            sets.append(shingle_set(text))
    if fps:
        yield close(fps, sets)


def links(docs: DataFrame, prints: DataFrame, n_sets: int, text: str = "text") -> DataFrame:
    """Star edges (node, root) of the components of prints' sets, of which there are n_sets different ones."""
    own = cut(meetings(prints), n_sets)
    tiles = F.least("n", F.ceil(F.col("shingles") / TILE)).alias("tiles")  # no more than there are sets, however long these are
    groups = own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).where("n > 1").select("name", tiles)
    wanted = cut(own.join(small(cut(groups, n_sets), MAX_COMPONENTS), "name").select("fp", "c_hash", "name", "tiles"), n_sets)
    texts = docs.select(F.xxhash64(text_of(text)).alias("text_hash"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = texts.join(small(wanted, MAX_CANDIDATES), F.col("text_hash") == F.col("c_hash"))
    texts = texts.groupBy("fp", "name", "tiles").agg(F.first("text").alias("text"))  # copies of a text are one
    tile = F.pmod(F.xxhash64("fp"), "tiles")
    texts = texts.select("*", tile.alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")).where("tiles = 1 OR tile != other")
    blocks = texts.select(F.xxhash64("name", F.least("tile", "other"), F.greatest("tile", "other")).alias("block"), "fp", "text")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return connected(map_arrow(blocks.repartition(parts, "block").sortWithinPartitions("block"), _links, "a long, b long"))


def keep_one_similar(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of near copies, with docs' own columns, chosen as by simhash.keep_one."""
    prints = cut(_prints(docs, text, key))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    found = named(prints.select("id", "text_hash", "fp"), nodes, links(docs, prints, nodes.count(), text))
    return one_of_each(docs, found, text, key)
