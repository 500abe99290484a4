"""The near-dup stage against brute-force Jaccard similarity of five-word shingles."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import jaccard
from sluice.llm.simhash import fingerprint

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """Ids that stay: the smallest of each group linked at 0.8 or more, pairs by an inverted index."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    holders, parent = {}, {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        shared = Counter(j for s in (own or {None}) for j in holders.get(s, ()))
        for j, n in shared.items():
            if not own or 5 * n >= 4 * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in own or {None}:
            holders.setdefault(s, []).append(i)
    return sorted(i for i in parent if root(i) == i)


def edited_rows():
    """Texts with edited copies on both sides of 0.8, a large family of copies, a chain, and short texts."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for n in (12, 30, 60, 200, 1500):
        for _ in range(12):
            words = [word() for _ in range(n)]
            rows.append(" ".join(words))
            for edits in (1, max(1, n // 50), max(2, n // 30), max(3, n // 10)):
                copy = list(words)
                for at in rng.sample(range(n), edits):
                    copy[at] = word()
                rows.append(" ".join(copy))
    base = [word() for _ in range(120)]
    for _ in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        rows.append(" ".join(copy))
    for _ in range(30):
        base[rng.randrange(120)] = word()
        rows.append(" ".join(base).upper())
    return list(enumerate([*rows, "two words", "Two  words", "other words", "", " \n", None]))


def test_edited_copies(spark, monkeypatch):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_force(rows)
    assert len(rows) - len(want) > 400
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want
    monkeypatch.setattr(jaccard, "CHUNK", 20)  # large groups are cut
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == want


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert found == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_shards_of_similar_sets():
    """Pairs at 0.8 share shards and are near there, unrelated ones are not; copies of a set share all."""
    rng = np.random.default_rng(3)
    for size, other, shared in ((4, 5, 4), (9, 9, 8), (90, 90, 80), (900, 720, 720)):
        sets = [rng.integers(0, 1 << 64, size + other - shared, np.uint64) for _ in range(300)]
        one, two = (np.stack([jaccard.votes(s) for s in some]) for some in ([s[:size] for s in sets], [s[size - shared :] for s in sets]))
        words = [jaccard.print_words(v) for v in (one, two)]
        assert [w for w in words[0][:, 0].tolist()] == [fingerprint(s[:size]) for s in sets]
        shards = [jaccard.cells(v) for v in (one, two)]
        assert (shards[0] == shards[1]).any(axis=1).all()
        assert np.bitwise_count((words[0] ^ words[1]).view(np.uint64)).sum(axis=1).max() <= jaccard.WIDE
        assert (shards[0] == np.roll(shards[1], 1, axis=0)).sum() < 20
        assert np.array_equal(jaccard.cells(one[:1]), shards[0][:1])
    assert jaccard.cells(jaccard.votes(np.zeros(0, np.uint64))[None]).shape == (1, jaccard.SHARDS)


def connected(links):
    groups = {}
    for a, b in links:
        both = groups.get(a, {a}) | groups.get(b, {b})
        groups.update((i, both) for i in both)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


class Ways:
    """Rows that come in batches of seven."""

    def __init__(self, rows):
        self.rows = rows

    def mapInArrow(self, run, schema):  # noqa: N802
        parts = [self.rows[i : i + 7] for i in range(0, len(self.rows), 7)]
        batches = (pa.RecordBatch.from_arrays([pa.array([r[0] for r in p], pa.int32()), *[pa.array([r[1][i] for r in p], pa.int64()) for i in range(3)]], ["shard", *jaccard.WORDS]) for p in parts)
        return [link for b in run(batches) for link in zip(*(c.to_pylist() for c in b.columns))]


def test_runs_of_shards(monkeypatch):
    """Links of shards that go over several batches connect what pairs within the radius connect; crowded shards are one group."""
    rng, rows = random.Random(4), []
    for shard, size in enumerate((1, 2, 2, 3, 12, 1, 7, 25, 1, 14, 2)):
        base = rng.getrandbits(192)
        for _ in range(size):
            value = base if rng.random() < 0.6 else rng.getrandbits(192)
            for bit in rng.sample(range(192), rng.choice((0, 5, 40))):
                value ^= 1 << bit
            rows.append((shard, value))
    signed = [(s, np.frombuffer(v.to_bytes(24, "little"), np.int64).tolist()) for s, v in rows]
    first = dict(zip([v for _, v in rows], [w[0] for _, w in signed]))

    def want(crowd):
        sizes = Counter(s for s, _ in rows)
        return connected((first[a], first[b]) for s, a in rows for t, b in rows if s == t and (sizes[s] > crowd or (a ^ b).bit_count() <= jaccard.WIDE))

    for crowd in (512, 10, 4):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        assert connected(jaccard._shard_links(Ways(signed))) == want(crowd)
    assert want(4) != want(512)


def test_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 5)
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == brute_force(rows)


def family(n, length=120, edits=1):
    """Near copies of one text, and a chain whose ends are not alike."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    rows = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(length), edits):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    for _ in range(40):
        for at in rng.sample(range(length), 2):
            base[at] = f"y{rng.randrange(10**6)}"
        rows.append(" ".join(base))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_links_of_a_family_grow_with_its_size(spark, monkeypatch):
    """Not with its square, however many chunks it is cut into, and not by a link for each shard."""
    monkeypatch.setattr(jaccard, "CHUNK", 20)
    rows, found = family(400), []
    table = spark.createDataFrame(rows, "at bigint, text string").repartition(3).cache()
    contract = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links, *more: found.append(links.distinct().count()) or contract(links, *more))
    links = jaccard.similar_links(table)
    assert links.count() < 2 * len(rows)  # one per text, some 20 per pair of chunks before
    assert sum(found) < 20 * len(rows)
    parts = connected([(a, b) for a, b in links.collect()])
    assert sorted(set(range(len(rows))) - {i for g in parts for i in g - {min(g)}}) == brute_force(rows)


def test_kinds_apart_meet_across_chunks(spark, monkeypatch):
    for chunk, pivots, edits in ((3, 1, 4), (16, 2, 3), (40, 8, 4)):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        rows = family(60, edits=edits)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == brute_force(rows)


def test_names_of_rows_in_shards(monkeypatch):
    """Rows of one name are connected already; the links lead from name to name."""
    rng, rows = random.Random(8), []
    for shard, size in enumerate((2, 2, 3, 9, 30)):
        base = rng.getrandbits(192)
        rows += [(shard, base ^ 1 << rng.randrange(192), rng.choice((None, 5, 6, 7 + shard))) for _ in range(size)]
    words = [np.frombuffer(v.to_bytes(24, "little"), np.int64).tolist() for _, v, _ in rows]

    class Named:
        def mapInArrow(self, run, schema):  # noqa: N802
            columns = [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([w[i] for w in words], pa.int64()) for i in range(3)], pa.array([r[2] for r in rows], pa.int64())]
            whole = pa.RecordBatch.from_arrays(columns, ["shard", *jaccard.WORDS, "name"])
            return [link for b in run(iter([whole.slice(i, 7) for i in range(0, len(rows), 7)])) for link in zip(*(c.to_pylist() for c in b.columns))]

    names = [w[0] if r[2] is None else r[2] for r, w in zip(rows, words)]
    for crowd in (512, 4):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        links = jaccard._shard_links(Named())
        assert all(a != b for a, b in links) and len(links) < len(rows)
        assert connected(links) == connected((a, b) for (s, _, _), a in zip(rows, names) for (t, _, _), b in zip(rows, names) if s == t and a != b)


def test_shards_travel_by_their_first_bit(spark):
    """A fingerprint is shuffled once for a first bit; behind the shuffle it stands in all shards of ``cells``, shard by shard."""
    rng = np.random.default_rng(6)
    shards = jaccard.cells(np.stack([jaccard.votes(rng.integers(0, 1 << 64, 50, np.uint64)) for _ in range(40)]))
    cells = jaccard.packed(shards)
    assert cells.shape == (40, jaccard.FIRSTS) and jaccard.SHARDS >= 3 * jaccard.FIRSTS
    rows = [(int(c), i) for i, own in enumerate(cells) for c in own]
    dealt = jaccard._dealt(spark.createDataFrame(rows, "cell bigint, at bigint"))
    found = [(r.shard, r.at, r.part) for r in dealt.withColumn("part", F.spark_partition_id()).collect()]
    assert sorted(f[:2] for f in found) == sorted((int(s), i) for i, own in enumerate(shards) for s in own)
    assert len({(s, part) for s, _, part in found}) == len({s for s, _, _ in found})
    for part in {f[2] for f in found}:
        own = [s for s, _, p in found if p == part]
        assert own == sorted(own)
