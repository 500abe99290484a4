"""Token counts that follow edits.

A document's state is a segment tree over its parts (runs of white space with the word after them, each a
whole number of pre-tokens): leaves of up to LEAF parts with their characters and tokens, and above
them sums of two children each. An edit is located by descending the sums of characters. Only the
touched leaves with the context at their borders are encoded again, up to the first old border that the new
text meets again, and the sums on the way to the root are renewed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.functions.names import column, quoted
from sluice.llm.bpe import PART, Encoder
from sluice.llm.common import extended, slices, whole_text, worker_state

LEAF = 32  # parts of a leaf
LONG = 1 << 20  # characters of a text that is cut step by step
LOOKBACK = 3  # characters before an edit that a pre-token may have looked ahead over

Edit = tuple[int, int, str]  # start, end and new text, in characters of the old text


class SegmentTree:
    """Sums of characters and tokens over leaves, as two arrays: node 1 is the root, node i has children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.width = 1 << max(0, (self.leaves - 1).bit_length())
        self.chars, self.tokens = (self._sums(x) for x in (chars, tokens))

    def _sums(self, values: list[int]) -> list[int]:
        sums = [0] * (2 * self.width)
        sums[self.width : self.width + len(values)] = values
        for node in range(self.width - 1, 0, -1):
            sums[node] = sums[2 * node] + sums[2 * node + 1]
        return sums

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character; the last leaf for the end."""
        node, first = 1, 0
        while node < self.width:
            left = self.chars[2 * node]
            if place - first < left or not self.chars[2 * node + 1]:
                node = 2 * node
            else:
                node, first = 2 * node + 1, first + left
        return node - self.width, first

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        """New sums of a leaf and of the nodes above it."""
        node = leaf + self.width
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def tokens_before(self, leaf: int) -> int:
        """Tokens of all leaves before one, from the sums beside the way to the root."""
        node, total = leaf + self.width, 0
        while node > 1:
            if node % 2:
                total += self.tokens[node - 1]
            node //= 2
        return total

    def leaf_sums(self) -> tuple[list[int], list[int]]:
        return self.chars[self.width : self.width + self.leaves], self.tokens[self.width : self.width + self.leaves]


class Counter:
    """Counts of tokens by part, remembered per worker."""

    def __init__(self, definition: str, added: bool = False):
        self.encoder = Encoder(definition, added)

    def counts(self, parts: list[str]) -> list[int]:
        known, width = self.encoder.known, np.dtype(self.encoder.dtype).itemsize
        missing = {p for p in parts if p not in known}
        if missing:
            self.encoder.learn(missing)
        return [len(known[p]) // width for p in parts]

    def trim(self) -> None:
        self.encoder.trim()


def cut(text: str, start: int = 0) -> Iterator[str]:
    """The parts of a text from a border on: white space with the word after it."""
    for match in PART.finditer(text, start):
        yield match.group()


def build(text: str, counter: Counter) -> SegmentTree:
    """The tree of a whole text."""
    chars, tokens = [], []
    parts: list[str] = []
    # Both ways end parts before white space only; the first is faster but makes one list of a whole text.
    for part in Encoder.parts(text) if len(text) <= LONG else cut(text):
        parts.append(part)
        if len(parts) == LEAF * 512:
            _add_leaves(parts, counter, chars, tokens)
            parts = []
    _add_leaves(parts, counter, chars, tokens)
    return SegmentTree(chars or [0], tokens or [0])


def _add_leaves(parts: list[str], counter: Counter, chars: list[int], tokens: list[int]) -> None:
    counts = counter.counts(parts)
    for start in range(0, len(parts), LEAF):
        chars.append(sum(map(len, parts[start : start + LEAF])))
        tokens.append(sum(counts[start : start + LEAF]))


def apply_edits(text: str, tree: SegmentTree, edits: list[Edit], counter: Counter) -> tuple[str, SegmentTree, int]:
    """The edited text, its tree, and how many characters were encoded again.

    Edits are given in places of the old text and must not overlap; those at one place apply in the order of their ends
    and texts. One sweep from left to right joins the new text once and encodes each touched run of leaves once, so the work
    is linear in the text and its edits. The tree is changed in place, and built anew, once, where the number of leaves changes.
    """
    ordered, kept, done = sorted(edits), [], 0
    for start, end, new in ordered:
        if not 0 <= start <= end <= len(text):
            raise ValueError(f"no place {start} to {end} in a text of {len(text)} characters")
        if start < done:
            raise ValueError("edits overlap")
        kept += [text[done:start], new]
        done = end
    edited = "".join([*kept, text[done:]])
    runs, at, moved = [], 0, 0
    while at < len(ordered):
        run, at, moved = _touched(edited, tree, ordered, at, moved, counter)
        runs.append(run)
    again = sum(sum(chars) for _, _, chars, _ in runs)
    if all(len(chars) == last - first + 1 for first, last, chars, _ in runs):
        for first, _, chars, tokens in runs:
            for leaf, (c, t) in enumerate(zip(chars, tokens), first):
                tree.set(leaf, c, t)
        return edited, tree, again
    old_chars, old_tokens = tree.leaf_sums()
    chars, tokens, done = [], [], 0
    for first, last, new_chars, new_tokens in runs:
        chars += old_chars[done:first] + new_chars
        tokens += old_tokens[done:first] + new_tokens
        done = last + 1
    return edited, SegmentTree(chars + old_chars[done:], tokens + old_tokens[done:]), again


Run = tuple[int, int, list[int], list[int]]  # first and last old leaf, and the sums of the leaves in their place


def _touched(edited: str, tree: SegmentTree, edits: list[Edit], at: int, moved: int, counter: Counter) -> tuple[Run, int, int]:
    """The run of leaves that the next edit touches, with all further edits in it, the edit after them, and how far they move text.

    ``moved`` says how far the edits before have moved the text. ``tree`` is the one of the old text.
    """
    first, begin = tree.leaf_at(max(0, edits[at][0] - LOOKBACK))
    last, border, reach = first, begin + tree.chars[tree.width + first], 0  # in places of the old text
    place = start = begin + moved  # in places of the new text

    def widen() -> None:
        # Take in edits near the run, and leaves until it holds their ends and is not behind the new text.
        nonlocal last, border, reach, at, moved
        while True:
            if at < len(edits) and edits[at][0] - LOOKBACK < border:
                moved += len(edits[at][2]) - (edits[at][1] - edits[at][0])
                reach = edits[at][1]
                at += 1
            elif (border <= reach or place > border + moved) and last + 1 < tree.leaves:
                last += 1
                border += tree.chars[tree.width + last]
            else:
                return

    widen()
    # Cut from the first border before the edits until a border of the old leaves is met again.
    parts: list[str] = []
    for part in cut(edited, start):
        if place == border + moved:
            break
        parts.append(part)
        place += len(part)
        widen()
    chars, tokens = _dealt([len(p) for p in parts], counter.counts(parts), last - first + 1)
    return (first, last, chars, tokens), at, moved


def _dealt(sizes: list[int], counts: list[int], leaves: int) -> tuple[list[int], list[int]]:
    """Parts dealt to as many leaves as before if they hold between one and twice LEAF parts each, else to as many as needed."""
    if not leaves <= len(sizes) <= 2 * LEAF * leaves:
        leaves = max(1, -(-len(sizes) // LEAF))
    cuts = [len(sizes) * i // leaves for i in range(leaves + 1)]
    spans = list(zip(cuts, cuts[1:]))
    return [sum(sizes[a:b]) for a, b in spans], [sum(counts[a:b]) for a, b in spans]


STATE = "leaf_chars array<int>, leaf_tokens array<int>"


def _counter(definition: str) -> Counter:
    return worker_state(f"counts {zlib.crc32(definition.encode())}", lambda: Counter(definition, added=True))


def count_tokens(docs: DataFrame, definition: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and the state ``leaf_chars, leaf_tokens``; columns of these names are replaced.

    ``definition`` is the content of a tokenizer file; strings of its added tokens count as these tokens. A null
    text is an empty one, with one empty leaf.
    """
    made = ("n_tokens", "leaf_chars", "leaf_tokens")
    own = [c for c in docs.columns if c not in made]
    rows = docs.select(*[column(c) for c in own])
    schema = extended(rows.schema, "n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(definition)
        for batch in slices(batches):
            counter.trim()
            trees = [build(t or "", counter) for t in batch.column(own.index(text)).to_pylist()]
            sums = [t.leaf_sums() for t in trees]
            columns = [
                *batch.columns,
                pa.array([t.n_tokens for t in trees], pa.int64()),
                pa.array([c for c, _ in sums], pa.list_(pa.int32())),
                pa.array([t for _, t in sums], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*own, *made])

    return rows.mapInArrow(run, schema)


def recount(counted: DataFrame, definition: str, edits: Callable[[str], list[Edit]] | str, text: str = "text") -> DataFrame:
    """Rows of ``count_tokens`` after edits: the new text, counts and state, with ``n_edits`` and ``chars_encoded``.

    ``edits`` is a function from a text to its edits, or the name of a column of arrays of
    ``struct<start, end, text>``. A null array is no edit. Rows without edits keep their state untouched.
    """
    made = ("n_tokens", "leaf_chars", "leaf_tokens", "n_edits", "chars_encoded")
    given = edits if isinstance(edits, str) else None
    own = [c for c in counted.columns if c not in (text, given, *made)]
    extra = [column(given)] if given else []
    rows = counted.select(*[column(c) for c in own], whole_text(text).alias("__text"), "leaf_chars", "leaf_tokens", *extra)
    schema = extended(
        counted.select(*[column(c) for c in own]).schema,
        f"{quoted(text)} string, n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>, n_edits int, chars_encoded bigint",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(definition)
        for batch in slices(batches):
            counter.trim()
            k = len(own)
            found = []
            for i, (t, chars, tokens) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(k, k + 3)))):
                wanted = [(e["start"], e["end"], e["text"]) for e in batch.column(k + 3)[i].as_py() or []] if given else edits(t)
                if not wanted:
                    found.append((t, sum(tokens), chars, tokens, 0, 0))
                    continue
                tree = SegmentTree(chars, tokens)
                t, tree, again = apply_edits(t, tree, wanted, counter)
                found.append((t, tree.n_tokens, *tree.leaf_sums(), len(wanted), again))
            types = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64())
            columns = [pa.array([f[j] for f in found], kind) for j, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], [*own, text, *made])

    return rows.mapInArrow(run, schema)


def with_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``edits`` from rows ``doc_id, start, end, text``; those of a null id are for no document."""
    grouped = edits.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id"))
    edit = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").cast("string").alias("text"))
    grouped = grouped.agg(F.collect_set(edit).alias("edits"))
    return docs.drop("edits").join(grouped, column(doc_id) == F.col("__id"), "left").drop("__id")
