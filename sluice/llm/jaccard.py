"""Near-duplicates by the Jaccard similarity of word shingles: SimHash shards, BK-trees, exact sets.

The votes of a text's shingles on 256 bits are its SimHash; the signs of the first 192 are its fingerprint. A
fingerprint of 64 bits has no block that texts at a similarity of 0.8 surely share, so shards are keyed by the bits
least likely to differ: the votes are turned by a Hadamard transform with random signs, each time anew, and the
clearest bit of a turn, with its value, is what near texts agree in. Two such bits, 18 binary digits, name a shard; a
text is in ``SHARDS`` of them. ``SECONDS`` shards share their first bit, and a text travels once for each first bit, with
the second ones: so its fingerprint is shuffled ``FIRSTS`` times, not once for each shard, however many tasks there are.
Each shard is a BK-tree with a wide radius; its links connect candidate groups. A
shard with more than ``CROWD`` fingerprints, copies of one text mostly, is a group as it is, which loses nothing.
A group's texts meet in one task, or, if there are many, chunk by chunk with a few texts of the whole group, which
connect most of what belongs together; there a BK-tree over 64-bit fingerprints rules pairs out and the sets of
shingles decide. What is then still apart in a group meets in one task per pair of chunks; chunks of one class do not.
Only the shards and the radii can miss a pair. At a similarity of 0.8 the shards are expected to miss a few in
a million (calculated, see README), fewer above; the 64-bit radius missed none of 45,346 pairs of tests/llm/test_jaccard.py (16 bits at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sluice.functions.names import column
from sluice.llm.bktree import BkTree, forest
from sluice.llm.common import among, hold, slices, whole_text, without
from sluice.llm.components import components
from sluice.llm.simhash import PIECE, _links, fingerprint, shingle_hashes

VOTES = 256  # bits that shingles vote on, a power of two
PRINT = 192  # bits of them that are the fingerprint, in words of 64
VALUE = 9  # binary digits of a turn's clearest bit with its value, 2 * VOTES of them
FIRSTS = 44  # first bits of a text's shards; the fingerprint travels once for each
SECONDS = 3  # shards with the same first bit
SHARDS = FIRSTS * SECONDS  # shards of a text
EARLY = 6  # first bits whose shards are linked before the others
WIDE = 62  # bits of PRINT; texts at 0.8 differ in 29 on average, with a deviation of 5, unrelated ones in 96, with one of 7
CROWD = 512  # fingerprints of a shard that get a tree; unrelated texts would fill shards so only beyond 100 million
RADIUS = 28  # bits; texts at 0.8 differ in 10 on average, with a deviation of 3, unrelated ones in 32
CHUNK = 256  # texts of a chunk of a large candidate group
PIVOTS = 8  # texts of a large candidate group, at most, that each of its chunks is compared with
POOL = -1  # the lot of a group's small classes; other lots are named by a row, and rows by numbers from 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit, how many hashes set it less how many do not; bits behind the first 64 are of mixed hashes."""
    counts = np.zeros(VOTES, np.int64)
    for start in range(0, len(hashes), PIECE):
        part = hashes[start : start + PIECE]
        more = [_mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(1, VOTES // 64)]
        wide = np.stack([part, *more], axis=1).view(np.uint8)
        counts += np.unpackbits(wide, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * counts - len(hashes)


def print_words(counts: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of votes, as rows of signed words."""
    return np.packbits(counts[:, :PRINT] > 0, axis=1, bitorder="little").view(np.int64)


def cells(counts: np.ndarray) -> np.ndarray:
    """The shards of rows of votes. Sums of whole numbers are exact here, so equal votes have equal shards."""
    turn = np.ones((1, 1), np.float32)
    while len(turn) < VOTES:
        turn = np.block([[turn, turn], [turn, -turn]])
    signs = np.random.default_rng(42).choice(np.array([-1, 1], np.float32), (FIRSTS + SHARDS, VOTES))
    counts, every = counts.astype(np.float32), np.arange(len(counts))
    found = np.empty((len(counts), FIRSTS + SHARDS), np.int32)
    for k in range(FIRSTS + SHARDS):
        turned = counts * signs[k] @ turn
        clearest = np.abs(turned).argmax(axis=1)
        found[:, k] = 2 * clearest + (turned[every, clearest] > 0)
    firsts = (np.arange(FIRSTS, dtype=np.int32) << VALUE) + found[:, :FIRSTS]
    return (np.repeat(firsts * SECONDS, SECONDS, axis=1) + np.arange(SHARDS, dtype=np.int32) % SECONDS << VALUE) + found[:, FIRSTS:]


def packed(shards: np.ndarray) -> np.ndarray:
    """A number for each first bit of rows of shards: the bit, then the second bits of its shards."""
    groups = shards.reshape(len(shards), FIRSTS, SECONDS).astype(np.int64)
    out = (groups[:, :, 0] >> VALUE) // SECONDS
    for j in range(SECONDS):
        out = (out << VALUE) + (groups[:, :, j] & (1 << VALUE) - 1)
    return out


def _dealt(ways: DataFrame) -> DataFrame:
    """``(shard, ...)`` of rows of ``(cell, ...)``, a packed number: they are shuffled by the first bit, then copied to its shards."""
    first = F.shiftright("cell", VALUE * SECONDS)
    second = [F.shiftright("cell", VALUE * (SECONDS - 1 - j)).bitwiseAND(F.lit((1 << VALUE) - 1)) for j in range(SECONDS)]
    shards = F.array(*[(F.shiftleft(first * SECONDS + j, VALUE) + b).cast("int") for j, b in enumerate(second)])
    rows = ways.repartition(first)
    return rows.select(F.explode(shards).alias("shard"), *[c for c in ways.columns if c != "cell"]).sortWithinPartitions("shard")


WORDS = [f"w{i}" for i in range(PRINT // 64)]  # columns of a fingerprint; the first names its text


def _marked(rows: DataFrame, shingle: int) -> DataFrame:
    """``at``, the fingerprint's words and ``cells``, its shards as packed numbers, of each row of ``(at, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            counts = np.stack([votes(np.unique(shingle_hashes(t, shingle))) for t in batch.column(1).to_pylist()])
            words = [pa.array(w, pa.int64()) for w in print_words(counts).T]
            shards = pa.array(packed(cells(counts)).reshape(-1), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * FIRSTS, pa.int32()), shards)
            yield pa.RecordBatch.from_arrays([batch.column(0), *words, lists], ["at", *WORDS, "cells"])

    return rows.mapInArrow(run, "at long, " + "".join(f"{w} long, " for w in WORDS) + "cells array<bigint>")


def run_links(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Links between names, the last column, of fingerprints, the others of ``words``, for each shard, a run of rows."""
    words, names = words[:, :-1], words[:, -1]
    sizes, links = ends - starts, []
    two = starts[sizes == 2]  # a tree of one
    apart = np.bitwise_count((words[two] ^ words[two + 1]).view(np.uint64)).sum(axis=1)
    near = two[(apart <= WIDE) & (names[two] != names[two + 1])]
    links += zip(names[near].tolist(), names[near + 1].tolist())
    for start, end in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
        if end - start > CROWD:
            links += _to_first(names[start:end])
            continue
        if (names[start:end] == names[start]).all():
            continue
        data, width = words[start:end].tobytes(), PRINT // 8
        values = [int.from_bytes(data[i : i + width], "little") for i in range(0, len(data), width)]
        name = dict(zip(values, names[start:end].tolist()))
        close = {(name[a], name[b]) for a, b in forest(list(name), WIDE, (1 << PRINT) - 1)}
        links += [(a, b) for a, b in close if a != b]
    return links


def _to_first(names: np.ndarray) -> list[tuple[int, int]]:
    return [(a, int(names[0])) for a in np.unique(names).tolist() if a != names[0]]


def _shard_links(ways: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of shards: rows of ``(shard, words)`` stand shard by shard, one shard in one task.

    A row is named by its first word, or by a further column where that is not null; rows of one name are linked already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, words, crowded = np.zeros(0, np.int32), np.zeros((0, len(WORDS) + 1), np.int64), False
        for batch in batches:
            shards = np.append(shards, batch.column(0).to_numpy())
            own = [batch.column(1 + i).to_numpy() for i in range(len(WORDS))]
            named = batch.num_columns > 1 + len(WORDS)
            own.append(pc.coalesce(batch.column(1 + len(WORDS)), batch.column(1)).to_numpy() if named else own[0])
            words = np.concatenate([words, np.stack(own, axis=1)])
            if not len(shards):
                continue
            cuts = np.append(np.flatnonzero(np.diff(shards, prepend=shards[0] - 1)), len(shards))
            starts, ends, links = cuts[:-1], cuts[1:], []
            if crowded:
                # All rows of this shard are linked to its first one, the only one kept.
                links += _to_first(words[: ends[0], -1])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                links += run_links(words, starts[:-1], ends[:-1])
                crowded = ends[-1] - starts[-1] > CROWD
                if crowded:
                    links += run_links(words, starts[-1:], ends[-1:])
                shards, words = shards[starts[-1] :], words[starts[-1] :]
            if crowded:
                shards, words = shards[:1], words[:1]
            yield _links(links)
        if len(shards) and not crowded:
            yield _links(run_links(words, np.array([0]), np.array([len(shards)])))

    return ways.mapInArrow(run, "a long, b long")


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are that similar; empty ones are alike."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def verified(sides: list[int], ats: list[int], kinds: list[int], texts: list[str], own: bool, shingle: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what pairs of similar texts connect: any pairs, or those across the sides only.

    Texts of one kind are connected already.
    """
    sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
    prints = [fingerprint(s) & (1 << 64) - 1 for s in sets]  # unsigned, so that all differing bits are counted
    tree, stored, links = BkTree(RADIUS), {}, []
    firsts: dict[int, int] = {}
    parent = [firsts.setdefault(kind, i) for i, kind in enumerate(kinds)]

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    def store(i: int) -> None:
        # Texts of one fingerprint share a node of the tree.
        if prints[i] not in stored:
            stored[prints[i]] = []
            tree.add(prints[i])
        stored[prints[i]].append(i)

    if not own:
        for i in range(len(ats)):
            if sides[i] == 0:
                store(i)
    for i in range(len(ats)):
        if own or sides[i] == 1:
            for place in tree.near(prints[i]):
                for k in stored[tree.values[place]]:
                    if root(i) != root(k) and _similar(sets[i], sets[k], similarity):
                        parent[root(i)] = root(k)
                        links.append((ats[i], ats[k]))
            if own:
                store(i)
    return links


def _linked(ways: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of the links of shards and those known before, a written table."""
    found = hold(_shard_links(_dealt(ways)), "jaccard-near")
    return hold(components(found if known is None else found.union(known), "a", "b", "jaccard-groups"), "jaccard-groups")


def similar_links(rows: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links ``(a, b)`` between rows of ``(at, text)`` that connect what similar pairs connect."""
    marked = hold(_marked(rows, shingle), "jaccard-prints")
    # Equal fingerprints go to the shards once.
    firsts = marked.groupBy(WORDS).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    again = hold(marked.join(firsts.where("n > 1"), WORDS).where("at <> first").select("at"), "jaccard-again")
    once = without(marked, again, "at")
    linked = _linked(once.select(F.explode(F.slice("cells", 1, EARLY)).alias("cell"), *WORDS))
    # Near copies share most shards: the other shards link what the first ones left apart, not all texts once more.
    named = among(once, linked.withColumnsRenamed({"node": "w0", "root": "name"}), "w0", how="left")
    more = named.select(F.explode(F.slice("cells", EARLY + 1, FIRSTS - EARLY)).alias("cell"), *WORDS, "name")
    linked = _linked(more, linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Texts that share the first word of their fingerprints are candidates too, linked or not.
    shared = marked.groupBy("w0").agg(F.count("*").alias("n")).where("n > 1").select(F.col("w0").alias("node"), F.col("w0").alias("root"))
    named = hold(linked.union(shared.join(linked, "node", "left_anti")), "jaccard-groups").withColumnRenamed("node", "w0")
    groups = hold(among(marked.select("at", "w0"), named, "w0").select("root", "at"), "jaccard-groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    placed = groups.join(sizes, "root").withColumn("low", F.pmod(F.xxhash64("at"), F.col("chunks")).cast("int"))
    placed = hold(placed.select("root", "at", "low", "chunks"), "jaccard-placed")
    links = hold(_met(rows, _with_pivots(placed), ["root", "low"], shingle, similarity), "jaccard-links")
    crowd = placed.where("chunks > 1").select("root", "at")
    if crowd.isEmpty():
        return links
    # Which links are of large groups is told by their rows.
    inner = among(links, crowd.select(F.col("at").alias("a")), "a")
    classes = components(inner, "a", "b", "jaccard-classes").select(F.col("node").alias("at"), F.col("root").alias("class"))
    crowd = crowd.join(classes, "at", "left").select("root", "at", F.coalesce("class", "at").alias("kind"))
    dealt = _apart(hold(crowd, "jaccard-classes"))
    across = hold(_met(rows, hold(dealt, "jaccard-placed"), ["root", "low_lot", "low", "high_lot", "high"], shingle, similarity), "jaccard-links")
    return links.union(across)


def _with_pivots(placed: DataFrame) -> DataFrame:
    """``(root, at, kind, low, side)``: each row in its own chunk, and pivots of a group of several chunks in all of them."""
    many = placed.where("chunks > 1")
    # One row of each of PIVOTS bins, by an order of its own.
    bins = many.groupBy("root", F.pmod(F.xxhash64("at", F.lit(1)), F.lit(PIVOTS)).alias("bin"))
    pivots = bins.agg(F.min(F.struct(F.xxhash64("at", F.lit(2)).alias("order"), "at", F.col("low").alias("own"), "chunks")).alias("p"))
    pivots = pivots.select("root", "p.at", "p.own", F.explode(F.sequence(F.lit(0), F.col("p.chunks") - 1)).alias("low"))
    both = placed.select("root", "at", "low").union(pivots.where("low <> own").select("root", "at", "low"))
    return hold(both.select("root", "at", F.col("at").alias("kind"), "low", F.lit(0).alias("side"), F.lit(True).alias("own")), "jaccard-placed")


def _apart(crowd: DataFrame) -> DataFrame:
    """Rows of ``(root, at, kind)`` of groups of several kinds, in each pair of chunks that may hold kinds still apart.

    A kind of CHUNK rows or more is a lot of its own, the others of a group are one lot. Pairs of chunks within a lot
    are left out if it is one kind. Small kinds stay whole in their chunk.
    """
    kinds = hold(crowd.groupBy("root", "kind").agg(F.count("*").alias("n")), "jaccard-classes")
    several = kinds.groupBy("root").agg(F.count("*").alias("kinds")).where("kinds > 1").select("root")
    kinds = kinds.join(several, "root").withColumn("lot", F.when(F.col("n") < CHUNK, F.lit(POOL)).otherwise(F.col("kind")))
    lots = kinds.groupBy("root", "lot").agg(F.ceil(F.sum("n") / F.lit(CHUNK)).cast("int").alias("chunks"))
    lots = hold(lots, "jaccard-classes")
    one, two = (lots.select("root", F.col("lot").alias(f"{side}_lot"), F.col("chunks").alias(f"{side}_chunks")) for side in ("low", "high"))
    pairs = one.join(two, "root").where(f"low_lot < high_lot or low_lot = {POOL} and high_lot = {POOL}")
    for side in ("low", "high"):
        pairs = pairs.withColumn(side, F.explode(F.sequence(F.lit(0), F.col(f"{side}_chunks") - 1)))
    same = F.col("low_lot") == F.col("high_lot")
    pairs = hold(pairs.where(~same | (F.col("low") <= F.col("high"))).drop("low_chunks", "high_chunks"), "jaccard-pairs")
    lot = kinds.select("root", "kind", "lot").join(lots, ["root", "lot"])
    key = F.when(F.col("lot") == POOL, F.col("kind")).otherwise(F.col("at"))
    rows = crowd.join(lot, ["root", "kind"]).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int")).drop("chunks")
    rows = hold(rows, "jaccard-placed")
    own = same & (F.col("low") == F.col("high"))
    dealt = []
    for number, side in enumerate(("low", "high")):
        met = pairs.where(~own) if number else pairs
        sided = rows.withColumnsRenamed({"lot": f"{side}_lot", "chunk": side})
        met = met.join(sided, ["root", f"{side}_lot", side])
        dealt.append(met.select("root", "at", "kind", "low_lot", "low", "high_lot", "high", F.lit(number).alias("side"), own.alias("own")))
    return dealt[0].union(dealt[1])


def _met(rows: DataFrame, dealt: DataFrame, place: list[str], shingle: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of texts that meet: ``dealt``, a written table, has ``at, kind, side, own`` and the columns of their place."""
    # Few rows are candidates: their ids go to the texts, not the texts to the ids.
    met = among(rows, dealt, "at").groupBy(*place, "own").agg(F.collect_list(F.struct("side", "at", "kind", "text")).alias("rows"))
    met = met.select("own", *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("side", "at", "kind", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, sides, ats, kinds, texts = (batch.column(k)[i].as_py() for k in range(5))
                links = verified(sides, ats, kinds, texts, own, shingle, similarity)
                a, b = zip(*links) if links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of rows linked by similar texts, with the columns of ``docs``.

    Two texts are similar if their sets of ``shingle`` words have that Jaccard similarity or more; a text of
    fewer words is one shingle, texts without words are alike. The row with the smallest id stays, nulls
    last; of rows that repeat an id any one. Very long texts are compared whole; an empty table gives an empty result;
    other columns, whatever their names, come through.
    """
    row = F.struct(*[column(c) for c in docs.columns])
    keyed = hold(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("at")), "jaccard-rows")
    rows = keyed.select("at", F.col("row").getField(text).alias("text")).select("at", whole_text().alias("text"))
    named = hold(components(similar_links(rows, shingle, similarity), "a", "b", "jaccard-components"), "jaccard-roots").withColumnRenamed("node", "at")
    # Most rows are alone: only the others are looked at again.
    ids = keyed.select("at", F.col("row").getField(doc_id).cast("long").alias("id"))
    known = hold(among(ids, named, "at"), "jaccard-ids")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")
    best = known.groupBy("root").agg(F.min(order).alias("best"))
    dropped = hold(known.join(best.select("root", F.col("best.at").alias("stays")), "root").where("at <> stays").select("at"), "jaccard-dropped")
    return without(keyed, dropped, "at").select("row.*")
