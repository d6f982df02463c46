import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chanspark.llm import similar
from chanspark.llm.similar import forest, keep_one_similar

from .helpers import LONG, PROSE, ROWS, docs, lower


def shingles(text):
    words = lower(text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def fingerprint_of(windows):
    hashes = [xxhash.xxh64_intdigest(b" ".join(w), 42) for w in windows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(sets):
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def kept_by_hand(rows):
    least = {}
    for (d, *_), g in zip(rows, components([shingles(r[1]) for r in rows]), strict=True):
        least[g] = min(least.get(g, (True, 0)), (d is None, d or 0))
    return sorted(least.values())


def drifting(n=60, words=200):
    """Texts that drift away from a first one, so that ends of a chain are not alike, and texts near the threshold."""
    rng = random.Random(5)
    new = lambda: f"word{rng.randrange(10**6)}"
    rows, text = [], [new() for _ in range(words)]
    for k in range(n):
        rows.append((100 + k, " ".join(text), "en", "s"))
        if k % 6 == 5:
            text = [new() for _ in range(words)]
        else:
            at = rng.randrange(words - 30)
            text = text[:at] + [new() for _ in range(rng.choice((1, 8, 14, 16, 18, 22)))] + text[at + 10 :]
    return rows


def test_near_copies(spark):
    rows = [r for r in ROWS if r[1] is not LONG] + drifting()
    want = kept_by_hand(rows)
    for stage in (keep_one_similar, lambda df: corpus_pipeline.near_duplicates(spark, df, "")):
        got = stage(docs(spark, rows))
        assert got.columns == docs(spark, rows).columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    assert keep_one_similar(docs(spark, [])).count() == 0


def test_rows_alike_in_id_and_text(spark):
    """The smallest by the other columns stays, in whatever order the rows come, also beside a column without an order."""
    rows = [(1, PROSE, "en", s) for s in ("web", "book", "code", None)]
    for some in (rows, rows[::-1]):
        table = docs(spark, some).withColumn("m", F.create_map(F.lit("k"), "source"))
        assert [(r.doc_id, r.source, r.m["k"]) for r in keep_one_similar(table).collect()] == [(1, None, None)]
        table = docs(spark, some[1:] if some[0][3] == "web" else some[:-1]).where("source IS NOT NULL").withColumn("m", F.create_map(F.lit("k"), "source"))
        assert [(r.doc_id, r.source, r.m["k"]) for r in keep_one_similar(table).collect()] == [(1, "book", "book")]


def test_near_copies_beyond_simhash(spark):
    """A pair of similarity 0.83 whose fingerprints differ in nine bits."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id IN (1, 177)")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()] == [1]


def test_pairs_within_the_balls(spark):
    """Without any minima, SimHashes of at most four differing bits still link all that are alike, and nothing else."""
    rng = random.Random(7)
    rows = []
    for _ in range(12):
        text = [f"word{rng.randrange(10**6)}" for _ in range(rng.choice((30, 100, 400)))]
        for _ in range(8):
            own = list(text)
            for at in rng.sample(range(len(own)), rng.choice((0, 1, 1, 2, 5))):
                own[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), "en", "s"))
    table = docs(spark, rows + [(900, None, "en", "s"), (901, " ", "en", "s")])
    prints = similar._prints(table, "text", "doc_id").withColumn("bands", F.array().cast("array<long>"))
    found = {r.id: r for r in prints.collect()}
    assert found[900].simhash is None and found[901].simhash is None
    sets, bits = [shingles(r[1]) for r in rows], [fingerprint_of(shingles(r[1])) for r in rows]
    assert [found[k].simhash & (1 << 64) - 1 for k in range(len(rows))] == bits
    near = lambda i, j: (bits[i] ^ bits[j]).bit_count() <= 4
    like = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] != sets[j] and near(i, j)]
    linked = [p for p in pairs if like(*p)]
    assert len(linked) > 20 and len(linked) < len(pairs)
    stars = {r.node: r.root for r in similar.links(table, prints, len({r.fp for r in found.values()})).collect()}
    component = lambda k: stars.get(found[k].fp, found[k].fp)
    assert all(component(i) == component(j) for i, j in linked)
    groups = components(sets)
    assert len({(component(k), groups[k]) for k in range(len(rows))}) == len({component(k) for k in range(len(rows))})


def test_balls_reach_the_threshold(spark):
    """SimHashes alone, without any minima, find every pair of similarity 0.8, of few shingles and of many."""
    rng = random.Random(11)
    rows = []
    for n in (4, 8, 20, 40, 200):
        for _ in range(40):
            words = [f"word{rng.randrange(10**6)}" for _ in range(n + n // 4 + 4)]
            rows += [(len(rows), " ".join(words[: n + 4]), "en", "s"), (len(rows) + 1, " ".join(words), "en", "s")]
    table = docs(spark, rows)
    prints = similar._prints(table, "text", "doc_id").withColumn("bands", F.array().cast("array<long>"))
    fp = {r.id: r.fp for r in prints.collect()}
    sets = [shingles(r[1]) for r in rows]
    bits = [fingerprint_of(s) for s in sets]
    pairs = [(k, k + 1) for k in range(0, len(rows), 2)]
    assert all(5 * len(sets[i] & sets[j]) == 4 * len(sets[i] | sets[j]) for i, j in pairs)
    assert sum((bits[i] ^ bits[j]).bit_count() > 4 for i, j in pairs) > 180
    stars = {(r.node, r.root) for r in similar.links(table, prints, len(rows)).collect()}
    assert stars == {(max(fp[i], fp[j]), min(fp[i], fp[j])) for i, j in pairs}


def test_large_buckets(monkeypatch):
    """Forests of large buckets join what the pairs of small ones join, across batches and whatever the further bits."""
    rng = np.random.default_rng(3)
    rows = []
    for bucket in range(1, 30):
        centres = [rng.integers(0, 1 << 64, 2, dtype=np.uint64) for _ in range(3)]
        for k in range(int(rng.integers(2, 40))):
            simhash, further = centres[k % 3] ^ (np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64))
            rows.append((bucket << similar.FURTHER | int(further) & (1 << similar.FURTHER) - 1, int(simhash.view(np.int64))))
    rows.sort()
    batches = [pa.RecordBatch.from_pylist([{"key": a, "fp": b} for a, b in rows[at : at + 7]]) for at in range(0, len(rows), 7)]

    def joined():
        own = {}
        for batch in similar._met(iter(batches)):
            groups = {}
            for r in batch.to_pylist():
                groups.setdefault(r["key"], []).append(r["simhash"])
            for group in groups.values():
                least = min(own.get(x, x) for x in group)
                held = {own.get(x, x) for x in group}
                own |= {x: least for x in [*own, *group] if own.get(x, x) in held}
        return own

    found = []
    for few in (1, similar.FEW, 100):
        monkeypatch.setattr(similar, "FEW", few)
        found.append(joined())
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) > 60


def much_alike(n, words=300, seed=17):
    """Texts of one family, any two of similarity about 0.7."""
    rng = random.Random(seed)
    base = [f"word{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(words), 5):
            own[at] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(own), "en", "s"))
    return rows


def test_groups_are_not_expanded_into_pairs(spark, monkeypatch):
    """Of texts that nearly all meet, a row each is kept of the meetings, and a row each is sent to be compared."""
    sent, plain = [], similar.map_arrow

    def counted(df, function, schema):
        if function is similar._links:
            sent.append(df.count())
        return plain(df, function, schema)

    monkeypatch.setattr(similar, "map_arrow", counted)
    for n in (40, 80):
        rows = much_alike(n)
        sets = [shingles(r[1]) for r in rows]
        below = sum(0.6 <= len(a & b) / len(a | b) < 0.8 for i, a in enumerate(sets) for b in sets[:i])
        assert below > 0.9 * n * (n - 1) / 2
        table = docs(spark, rows)
        prints = similar._prints(table, "text", "doc_id").cache()
        met = similar.meetings(prints)
        assert met.count() == n and met.select("name").distinct().count() == 1
        fp = {r.id: r.fp for r in prints.collect()}
        stars = {r.node: r.root for r in similar.links(table, prints, n).collect()}
        groups = components(sets)
        named = {(stars.get(fp[k], fp[k]), groups[k]) for k in range(n)}
        assert len(named) == len(set(groups)) == len({a for a, _ in named}) > 1
    assert sent == [40, 80]


def test_tiles(spark, monkeypatch):
    """Groups that are cut into tiles, a few sets each, have the links that whole ones have; copies are sent once."""
    rows = drifting(40) + [(d + 1000, t, a, s) for d, t, a, s in much_alike(30)] + [(d + 2000, t, a, s) for d, t, a, s in much_alike(30)]
    want = kept_by_hand(rows)
    assert 20 < len(want) < 65
    for tile in (similar.TILE, 2000, 100):
        monkeypatch.setattr(similar, "TILE", tile)
        assert sorted((False, r.doc_id) for r in keep_one_similar(docs(spark, rows)).collect()) == want


def test_later_masks_join_groups_only():
    """Rows of a bucket that go by the same name say nothing; others join names, by 98 bits that are not the name's."""
    rng = np.random.default_rng(4)
    rows = []
    for bucket in range(1, 40):
        bits, further = rng.integers(0, 1 << 63), rng.integers(0, 1 << similar.FURTHER)
        rows += [(bucket << similar.FURTHER | int(further), int(bits), name) for name in [bucket] * int(rng.integers(2, 40)) + [bucket + 100] * (bucket % 3 == 0)]
        rows.append((bucket << similar.FURTHER | int(further), int(~bits), bucket + 200))
    rows.sort()
    batches = [pa.RecordBatch.from_pylist([{"key": a, "bits": b, "name": c} for a, b, c in rows[at : at + 7]]) for at in range(0, len(rows), 7)]
    found = {(r["key"], r["simhash"]) for batch in similar._met(iter(batches)) for r in batch.to_pylist()}
    assert found == {(k, x) for k in range(3, 40, 3) for x in (k, k + 100)}


def test_forest():
    """Members that are unlike the least one, but like each other, are joined too."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        base = [np.arange(k * 100, k * 100 + 60) for k in range(3)]
        sets = [np.unique(np.concatenate((rng.choice(base[k % 3], 56, replace=False), rng.integers(1000, 9000, 3)))).astype("<u8") for k in range(12)]
        groups = [k // 2 if k < 4 else k for k in range(12)]
        plain = [set(s.tolist()) for s in sets]
        own = list(groups)
        for i in range(12):
            for j in range(i):
                if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j]):
                    own = [own[j] if g == own[i] else g for g in own]
        got = list(groups)
        for x, y in forest(sets, groups):
            assert 5 * len(plain[x] & plain[y]) >= 4 * len(plain[x] | plain[y])
            got = [got[x] if g == got[y] else g for g in got]
        assert len({*zip(own, got, strict=True)}) == len(set(own)) == len(set(got))


def test_components_of_any_graph(spark, monkeypatch):
    """Chains, hubs and random edges, with broadcasts and without."""
    from chanspark.llm import simhash

    rng = random.Random(12)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5)]
    own = {v: v for e in edges for v in e}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in edges:
        own[max(find(a), find(b))] = min(find(a), find(b))
    want = {v: find(v) for v in own if find(v) != v}
    table = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    for bound in (simhash.MAX_COMPONENTS, 0):
        monkeypatch.setattr(simhash, "MAX_COMPONENTS", bound)
        assert {r.node: r.root for r in simhash.connected(table).collect()} == want
