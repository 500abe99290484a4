"""Removal of repeated passages: Rabin-Karp hashes of every window of words, counted by Spark.

Texts are cut into words, and every window of ``window`` consecutive words gets a Rabin-Karp hash: prefix
sums of word hashes times powers of a base, so a window costs the difference of two sums. Three steps:

1. Rows are hashed in slices of bounded size. Where several rows of a slice hold a window, all but those of
   the smallest id are told to drop it at once; only the smallest id of each hash goes on, so a passage that a
   third of all rows share costs one entry per slice. Entries travel to buckets by hash, packed in blocks.
2. A bucket holds the entries of its hashes and tells every id but the smallest to drop them.
3. Told windows meet the texts by groups of ids; windows that overlap or touch merge into maximal intervals,
   which are cut out.

The numbers of buckets and groups follow from the amount of text, so a task holds about ``BUCKET`` windows or
words at a time, more only where one row is longer. Hashes have 64 bits: two given windows that differ fall
together with a probability of 2^-59 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.common import slices, whole_text

WINDOW = 13
BUCKET = 1 << 20  # windows of a bucket, words of a group of texts, on average
SLICE = 1 << 20  # words that are hashed together
CHARS = 6  # code points of a word and its gap; only the numbers of buckets and groups depend on it
BASE = 0x9E3779B97F4A7C15  # odd and 5 modulo 8, so that differences of its powers keep nearly all bits
PACKED = "part int, hashes binary, owners binary, ids binary"  # windows, and the rows (places in ids) that own them


class Roller:
    """Rabin-Karp hashes of windows modulo 2^64; powers of the base are computed once."""

    def __init__(self, window: int):
        self.window = window
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, count: int) -> None:
        if len(self.powers) < count:
            steps = np.full(max(count, 2 * len(self.powers)), BASE, np.uint64)
            steps[0] = 1
            self.powers = steps.cumprod(dtype=np.uint64)
            steps[1:] = pow(BASE, -1, 1 << 64)
            self.inverse = steps.cumprod(dtype=np.uint64)

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """One hash for each window of consecutive words; none if there are fewer words than a window has."""
        count = len(words) - self.window + 1
        if count < 1:
            return np.zeros(0, np.uint64)
        self._reach(len(words))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.powers[: len(words)], dtype=np.uint64, out=sums[1:])
        return (sums[self.window :] - sums[:count]) * self.inverse[:count]


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # on bytes: white space of ASCII only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers by planes of equal bytes, compressed: high bytes of sorted or small numbers cost next to nothing."""
    planes = numbers.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(block: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def mixed(ids: np.ndarray) -> np.ndarray:
    """As ``_mixed``: numbers whose remainders spread, whatever the pattern of the ids."""
    x = ids.view(np.uint64)
    for left, shift in ((True, 13), (False, 7), (True, 17)):
        x = x ^ (x << np.uint64(shift) if left else x >> np.uint64(shift))
    return x.view(np.int64)


def _mixed(ids: Column) -> Column:
    x = ids
    for left, shift in ((True, 13), (False, 7), (True, 17)):
        x = x.bitwiseXOR(F.shiftleft(x, shift) if left else F.shiftrightunsigned(x, shift))
    return x


def blocks(place: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Windows and the ids that own them, packed by place."""
    order = np.lexsort((hashes, place))
    place, hashes, ids = place[order], hashes[order], ids[order]
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            own, at = np.unique(ids[a:b], return_inverse=True)
            yield int(place[a]), pack(hashes[a:b]), pack(at.astype(np.int64)), pack(own)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Windows of packed rows, and their ids."""
    hashes, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for h, o, i in zip(*(rows.column(c).to_pylist() for c in ("hashes", "owners", "ids"))):
        hashes.append(unpack(h, np.uint64))
        ids.append(unpack(i, np.int64)[unpack(o, np.int64)])
    return np.concatenate(hashes), np.concatenate(ids)


def judged(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of window and id, sorted, and whether a smaller id holds the window as well."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])
    hashes, ids = hashes[first], ids[first]
    later = np.zeros(len(hashes), bool)
    later[1:] = hashes[1:] == hashes[:-1]
    return hashes, ids, later


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals covered by windows that start at the given places, which ascend."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), (starts[np.concatenate([breaks, [len(starts) - 1]])] + window).tolist()))


def _entries(rows: DataFrame, window: int, buckets: int, parts: int) -> DataFrame:
    """Step 1: ``bucket`` and packed windows; those with a ``part`` are told already and wait in any bucket."""

    def packed(texts: list[tuple[int, np.ndarray]], roller: Roller) -> Iterator[pa.RecordBatch]:
        found = [(i, roller.hashes(w)) for i, w in texts]
        ids = np.repeat(np.array([i for i, _ in found], np.int64), [len(h) for _, h in found])
        hashes, ids, later = judged(np.concatenate([h for _, h in found]), ids)
        told = [(p, p % buckets, *rest) for p, *rest in blocks(np.mod(mixed(ids[later]), parts), hashes[later], ids[later])]
        open_hashes = hashes[~later]
        bucket = ((open_hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        told += [(None, b, *rest) for b, *rest in blocks(bucket, open_hashes, ids[~later])]
        for row in told:
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "bucket", "hashes", "owners", "ids"), ([v] for v in row))), schema=arrow)

    arrow = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, waiting, size = Roller(window), [], 0
        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.append((i, word_hashes(words_of(text))))
                size += len(waiting[-1][1])
                if size >= SLICE:
                    yield from packed(waiting, roller)
                    waiting, size = [], 0
        if waiting:
            yield from packed(waiting, roller)

    return rows.mapInArrow(run, "part int, bucket int, hashes binary, owners binary, ids binary")


def _told(entries: DataFrame, parts: int) -> DataFrame:
    """Step 2: packed windows that rows are told to drop, by group of ids."""
    arrow = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        known = rows.column("part").is_valid()
        hashes, ids, later = judged(*unpacked(rows.filter(pa.compute.invert(known))))
        hashes, ids = hashes[later], ids[later]
        found = list(zip(*blocks(np.mod(mixed(ids), parts), hashes, ids))) or [[]] * 4
        told = pa.table([pa.array(list(v), f.type) for v, f in zip(found, arrow)], schema=arrow)
        return pa.concat_tables([told, rows.filter(known).select(arrow.names).cast(arrow)])

    return entries.groupBy("bucket").applyInArrow(run, PACKED)


def _cut(rows: DataFrame, told: DataFrame, window: int) -> DataFrame:
    """Step 3: the intervals of each row and the words that stay."""
    spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", spans), ("kept_text", pa.string())])

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        hashes, ids = unpacked(packed)
        order = np.argsort(ids, kind="stable")
        hashes, ids = hashes[order], ids[order]
        roller, out = Roller(window), ([], [], [], [])
        for doc_id, text in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist()):
            words, found = words_of(text), []
            if doc_id is not None:
                a, b = np.searchsorted(ids, [doc_id, doc_id + 1]) if doc_id < np.iinfo(np.int64).max else (np.searchsorted(ids, doc_id), len(ids))
                if a < b:
                    found = intervals(np.flatnonzero(np.isin(roller.hashes(word_hashes(words)), hashes[a:b])), window)
            kept, at = [], 0
            for first, end in found:
                kept += words[at:first]
                at = end
            kept += words[at:]
            for values, value in zip(out, (doc_id, len(words), [{"first": f, "end": e} for f, e in found], b" ".join(kept).decode())):
                values.append(value)
        return pa.table([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    both = rows.groupBy("part").cogroup(told.groupBy("part"))
    return both.applyInArrow(run, "doc_id long, n_words long, spans array<struct<first: long, end: long>>, kept_text string")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, spans, kept_text`` for every row; other columns are left out.

    A word goes if a window of ``window`` consecutive words covers it whose words also start in a row with a
    smaller id. Windows are judged on the input, not on what is left. ``spans`` are the maximal intervals of
    words removed, from ``first`` to before ``end``; ``kept_text`` has the words that stay, joined by one space.
    Words are runs without the white space of ASCII, compared as they are. A null text is an empty one; texts
    with fewer words than a window stay whole. Rows without an id have no smaller or larger one: they lose
    nothing and take nothing from others. Rows that share an id take nothing from each other. Very long texts
    are hashed whole, one after the other. An empty table gives an empty result.
    """
    known = F.col(doc_id).cast("long")
    rows = docs.select(known.alias("id"), whole_text(text).alias("text"))
    words = (rows.agg(F.sum(F.char_length("text").cast("long"))).first()[0] or 0) // CHARS
    places = words // BUCKET + 1
    entries = _entries(rows.where("id IS NOT NULL"), window, places, places)
    group = F.pmod(F.when(F.col("id").isNotNull(), _mixed(F.col("id"))).otherwise(F.xxhash64("text")), F.lit(places)).cast("int")
    return _cut(rows.withColumn("part", group), _told(entries, places), window)
