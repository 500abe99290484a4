import random
from collections import Counter

import xxhash
from hypothesis import given, settings, strategies as st

from sluice.llm import simhash
from sluice.llm.bktree import BkTree, crossing, forest
from sluice.llm.components import components
from sluice.llm.queries import op4_simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius):
    """The class number of each value, by comparing all pairs."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def names(rows, radius=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    of = classes(prints, radius)
    best = {}
    for (doc_id, _), c in zip(rows, of):
        if doc_id is not None:
            best[c] = min(best.get(c, doc_id), doc_id)
    return Counter((doc_id, f"{p:016x}", best.get(c)) for (doc_id, _), p, c in zip(rows, prints, of))


def test_query_against_brute_force(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    found = op4_simhash(spark, SF).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == names(rows)


def test_odd_rows(odd):
    found = simhash.near_duplicates(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found) == names(rows)


def test_one_of_each_group(odd, nothing):
    stay = simhash.one_of_each(odd)
    assert stay.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert stay.count() == len(set(classes([plain_fingerprint(t) for _, t in rows], 4)))
    assert simhash.one_of_each(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def ball(rng, n, bits, centre=None):
    centre = rng.getrandbits(64) if centre is None else centre
    out = set()
    while len(out) < n:
        v = centre
        for b in rng.sample(range(64), rng.randint(0, bits)):
            v ^= 1 << b
        out.add(v)
    return out


def test_links_on_all_ways(spark):
    """Sparse values, dense balls and chains, with limits so low that shards are split and cut into chunks."""
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(300)} | ball(rng, 60, 4) | ball(rng, 60, 9) | ball(rng, 40, 3, 0)
    at = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), 4):
            at ^= 1 << b
        values.add(at)
    values = sorted(values)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    want = {}
    for v, c in zip(values, classes(values, 4)):
        want.setdefault(c, set()).add(signed(v))
    want = {frozenset(c) for c in want.values() if len(c) > 1}
    size = simhash.SHARD
    try:
        for limit, chunk in ((2000, 2000), (20, 2000), (4, 12)):
            simhash.SHARD = chunk
            linked = components(simhash.fingerprint_links(frame, 4, limit), "a", "b")
            found = {}
            for r in linked.collect():
                found.setdefault(r.root, set()).add(r.node)
            assert {frozenset(c) for c in found.values()} == want
            assert all(root == min(c) for root, c in found.items())
    finally:
        simhash.SHARD = size


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=40), st.integers(0, 2**64 - 1), st.integers(0, 64))
def test_tree_finds_all_within_the_radius(values, query, radius):
    tree = BkTree(radius)
    for v in values:
        tree.add(v)
    assert sorted(tree.values[i] for i in tree.near(query)) == sorted(v for v in values if (v ^ query).bit_count() <= radius)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 255), unique=True, max_size=40), st.integers(0, 3))
def test_forests_connect_what_pairs_connect(values, radius):
    def joined(links):
        parent = {v: v for v in values}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in links:
            parent[root(a)] = root(b)
        return {frozenset(v for v in values if root(v) == root(u)) for u in values}

    pairs = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius]
    assert joined(forest(values, radius)) == joined(pairs)
    assert len(forest(values, radius)) < max(1, len(values))
    half = len(values) // 2
    split = forest(values[:half], radius) + forest(values[half:], radius) + crossing(values[:half], values[half:], radius)
    assert joined(split) == joined(pairs)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    order = rng.sample(range(1000), 200)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(2000, 2001 + i) for i in range(300)] + [(5000, 5000)]
    rng.shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "x bigint, y bigint"), "x", "y").collect()}
    assert found == {**{v: min(order) for v in order}, **{2000 + i: 2000 for i in range(301)}}
    assert components(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").count() == 0


def test_links_across_the_highest_bit(spark):
    """Two bits apart is a link, five bits are none, also where the sign of the stored number differs."""
    base = 0x0123456789ABCDEF
    for flips, linked in (((63, 0), True), ((63, 62, 61, 60), True), ((63, 62, 61, 60, 59), False), ((63, 1, 20, 40, 50), False)):
        other = base
        for bit in flips:
            other ^= 1 << bit
        frame = spark.createDataFrame([(signed(base),), (signed(other),)], "fp bigint")
        assert (simhash.fingerprint_links(frame, 4).count() > 0) == linked


def test_components_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = Counter((r.doc_id, r.fingerprint, r.component_id) for r in op4_simhash(spark, "/root/testdata/sf0.01").collect())
    assert found == names(rows)
