"""SimHash near-duplicates with BK-trees.

Whole texts become 64-bit fingerprints once. Two fingerprints that differ in at most ``radius``
bits agree in at least one of ``radius + 1`` blocks of bits, so every distinct fingerprint goes to
one shard per block, keyed by the block's bits, and only meets those of its shards. Each shard is a
BK-tree. A shard with more than ``SHARD`` fingerprints is dealt again by blocks of its remaining
bits; what is still larger is cut into chunks of bounded size whose trees are matched chunk
against chunk. Nothing is broadcast, no task holds more than two chunks, and a shard emits a
spanning forest, never its pairs. All ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.names import column
from sluice.llm.bktree import crossing, forest
from sluice.llm.common import hold, slices, whole_text, with_small
from sluice.llm.components import components

SHARD = 2000  # fingerprints in a tree
PIECE = 1 << 16  # shingles of a long text that are counted together


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, of all words if there are fewer."""
    words = text.encode().lower().split()  # on bytes: A-Z and the white space of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([one(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((one(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), PIECE):
        part = hashes[start : start + PIECE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row; a null text is an empty one, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` blocks that cover ``bits`` bits."""
    cuts = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block_value(bits: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))


def _without(bits: Column, shift: int, width: int) -> Column:
    """The bits with one block taken out, the higher ones moved down."""
    low = bits.bitwiseAND(F.lit((1 << shift) - 1))
    high = F.shiftrightunsigned(bits, shift + width) if shift + width < 64 else F.lit(0).cast("long")
    return F.shiftleft(high, shift).bitwiseOR(low)


def _shards(rows: DataFrame, key: Column, bits: Column, total: int, radius: int) -> DataFrame:
    """Each row once per block of ``bits``, with its shard and the bits that are left.

    Shards are named by a hash: if two share a name, they are searched as one, which loses nothing.
    """
    ways = [
        F.struct(F.xxhash64(key, F.lit(at), _block_value(bits, shift, width)).alias("shard"), _without(bits, shift, width).alias("rest"))
        for at, (shift, width) in enumerate(_blocks(total, radius + 1))
    ]
    return rows.select("fp", F.explode(F.array(*ways)).alias("way")).select("fp", "way.shard", "way.rest")


def _split(shards: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of shards with 2 to ``limit`` rows, and those of larger ones with the size ``n``."""
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n"))
    large = hold(sizes.where(F.col("n") > limit), "simhash-large")
    joined = with_small(shards, large, "shard")
    return joined.where("n IS NULL").drop("n"), joined.where("n IS NOT NULL")


def _forests(shards: DataFrame, radius: int) -> DataFrame:
    """Links of shards that fit one tree each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            links = [link for fps in batch.column(0).to_pylist() for link in forest(fps, radius)]
            yield _links(links)

    groups = shards.groupBy("shard").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    return groups.where(F.size("fps") > 1).select("fps").mapInArrow(run, "a long, b long")


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _chunk_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links of shards of any size: bounded chunks, each one's tree matched with each other chunk.

    A row goes to the pairs of its chunk only, and the chunks of a pair are dealt to a task of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for own, sides, fps in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first = [fp for fp, side in zip(fps, sides) if side == 0]
                second = [fp for fp, side in zip(fps, sides) if side == 1]
                yield _links(forest(first, radius) if own else crossing(first, second, radius))

    chunks = F.ceil(F.col("n") / F.lit(SHARD // 2)).cast("int")
    placed = shards.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, "chunk").alias("low"), F.greatest(c, "chunk").alias("high")))
    dealt = placed.select("shard", "fp", "chunk", F.explode(others).alias("pair"))
    side = (F.col("chunk") != F.col("pair.low")).cast("int").alias("side")
    dealt = dealt.select("shard", "fp", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), side)
    groups = dealt.groupBy("shard", "low", "high").agg(F.sort_array(F.collect_list(F.struct("side", "fp"))).alias("rows"))
    groups = groups.select((F.col("low") == F.col("high")).alias("own"), F.col("rows.side").alias("sides"), F.col("rows.fp").alias("fps"))
    return groups.mapInArrow(run, "a long, b long")


def fingerprint_links(distinct: DataFrame, radius: int = 4, limit: int = SHARD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, in column ``fp``, that connect what the radius connects."""
    small, large = _split(_shards(distinct, F.lit(0), F.col("fp"), 64, radius), limit)
    # The blocks are not all as wide: the most bits that can be left, the missing ones are zero.
    left = 64 - min(width for _, width in _blocks(64, radius + 1))
    fits, huge = _split(_shards(large, F.col("shard"), F.col("rest"), left, radius), limit)
    return hold(_forests(small, radius).union(_forests(fits, radius)).union(_chunk_links(huge, radius)), "simhash-links")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    Rows are linked if their fingerprints differ in at most ``radius`` bits; the component is named
    by the smallest id that can be reached. Rows without an id get their component's name too, which
    is null if no row in reach has an id. Repeated rows, ties and empty texts are linked like any
    others; an empty table gives an empty result.
    """
    marked = hold(fingerprints(docs, text, doc_id, shingle), "simhash")
    named = hold(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    linked = components(fingerprint_links(named.select("fp"), radius), "a", "b", "simhash-components")
    linked = hold(linked, "simhash-roots").withColumnRenamed("node", "fp")
    grouped = named.join(linked, "fp").select("fp", "root", "first_id")
    roots = hold(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-names")
    renamed = linked.join(roots, "root").select("fp", "component_id")
    # Few fingerprints are linked; the others keep their own first id.
    names = named.join(renamed, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(hold(names, "simhash-names"), "fp")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``.

    The row with the smallest id stays, nulls last; of rows that repeat an id any one.
    """
    row = F.struct(*[column(c) for c in docs.columns])
    keyed = hold(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("at")), "simhash-rows")
    names = near_duplicates(keyed.select("at", F.col("row").getField(text).alias("text")), "text", "at", shingle, radius)
    ids = keyed.select("at", F.col("row").getField(doc_id).cast("long").alias("id"))
    named = hold(names.select(F.col("doc_id").alias("at"), "component_id").join(ids, "at"), "simhash-groups")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")
    best = hold(named.groupBy("component_id").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1"), "simhash-best")
    # Most rows are alone in their group: only those to be dropped are joined with the texts.
    dropped = named.join(best.select("component_id", F.col("best.at").alias("stays")), "component_id").where("at <> stays").select("at")
    return keyed.join(dropped, "at", "left_anti").select("row.*")
