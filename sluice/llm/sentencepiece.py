"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a Viterbi pass.

The automaton holds all pieces. One pass over a text reports, at each position, the pieces that end
there, and each of them relaxes the position's best score from that of its own beginning. What a
step scores depends on the model's kind, read from its file:

* unigram: the sum of the pieces' scores;
* BPE: a step from one piece to the next scores 0 if merging the two in the order of ranks would leave
  them as they are, else minus infinity. A text's merges are the one path of score 0, so the ids are
  those of the merges.

No piece goes beyond a run of spaces and the word after it, nor across two characters that stand side by
side in no piece: what lies between such borders is encoded by itself, and equal words and parts are
encoded once per worker. Characters without a piece become bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from sluice.functions.names import column
from sluice.llm.common import extended, slices, whole_text, worker_state

SPACE = "▁"
CACHE = 600_000  # words that a worker remembers
PARTS = 400_000  # parts of words, and pairs of pieces, that it remembers
LONGEST = 64  # characters of a unit that is remembered
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NEVER = float("-inf")


class Codec:
    """Encoder and decoder for the content of a model file (unigram or BPE, with byte pieces)."""

    def __init__(self, model: bytes):
        given = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = given.get_piece_size()
        plain = [i for i in range(size) if not (given.is_control(i) or given.is_unknown(i) or given.is_byte(i) or given.is_unused(i))]
        self.pieces = {given.id_to_piece(i): i for i in plain}
        self.scores = [given.get_score(i) for i in range(size)]
        self.bytes = {int(given.id_to_piece(i)[3:5], 16): i for i in range(size) if given.is_byte(i)}
        self.unknown = given.unk_id()
        self.least = min(self.scores)
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.merges = model_kind(model) == 2
        self.prefix = given.encode("a", out_type=str)[:1] != ["a"]
        # Ids of words: those that begin a line, and those after one space.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.parts: dict[str, bytes] = {}
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.lines = not any("\n" in p for p in self.pieces)
        self.text_of = [b""] * size
        for piece, i in self.pieces.items():
            self.text_of[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.text_of[i] = bytes([value])
        self.text_of[self.unknown] = " ⁇ ".encode()
        # Numbers beyond the ids stand for single characters that have no piece.
        self.letters: dict[str, int] = {}
        self.strings: dict[int, str] = {i: p for p, i in self.pieces.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stays: dict[tuple[int, int], bool] = {}
        if self.merges:
            # A piece that its own merges do not lead to can never be seen.
            reached = {p: i for p, i in self.pieces.items() if len(p) == 1 or self.merged(p) == [i]}
        else:
            reached = self.pieces
        self.automaton = ahocorasick.Automaton()
        for piece, i in reached.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()

    def number(self, letter: str) -> int:
        found = self.pieces.get(letter)
        if found is None:
            found = self.letters.setdefault(letter, len(self.scores) + len(self.letters))
            self.strings[found] = letter
        return found

    def merged(self, unit: str, split: dict | None = None) -> list[int]:
        """The merges carried out one by one: best score first, then leftmost."""
        parts = list(unit)
        after, before, alive = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [True] * len(parts)
        todo: list[tuple] = []

        def offer(a: int, b: int) -> None:
            i = self.pieces.get(parts[a] + parts[b])
            if i is not None:
                heapq.heappush(todo, (-self.scores[i], a, b, parts[a] + parts[b]))

        for at in range(len(parts) - 1):
            offer(at, at + 1)
        while todo:
            _, a, b, joined = heapq.heappop(todo)
            if not (alive[a] and alive[b]) or after[a] != b or parts[a] + parts[b] != joined:
                continue
            if split is not None:
                split[joined] = (parts[a], parts[b])
            parts[a], alive[b], after[a] = joined, False, after[b]
            if after[b] < len(parts):
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [self.number(p) for p, there in zip(parts, alive) if there]

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two parts whose merge makes a piece; None for a single character."""
        if i not in self.halves:
            string, split = self.strings[i], {}
            if len(string) > 1:
                self.merged(string, split)
            pair = split.get(string)
            self.halves[i] = (self.number(pair[0]), self.number(pair[1])) if pair else None
        return self.halves[i]

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces in rank order ends in these two pieces.

        Seen backwards: the later of the last merges on either side is undone, and each time the parts
        that then touch must not have a merge that would have come first.
        """
        found = self.stays.get((left, right))
        if found is None:
            if len(self.stays) > PARTS:
                self.stays.clear()
            found = self.stays[left, right] = self._stable(left, right)
        return found

    def _stable(self, left: int, right: int) -> bool:
        pieces, strings, scores = self.pieces, self.strings, self.scores
        bound = NEVER  # score of the merge that was undone last, on the left or right of the border
        from_left = False
        while True:
            across = pieces.get(strings[left] + strings[right])
            if across is not None:
                score = scores[across]
                # Among equal scores the leftmost merge comes first: one on the left beats one across.
                if score > bound or (score == bound and not from_left):
                    return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and scores[left] <= scores[right] and (scores[left] < scores[right])):
                bound, from_left, left = scores[left], True, a[1]
            elif a is None or scores[right] < scores[left]:
                bound, from_left, right = scores[right], False, b[0]
            else:  # equal scores: the right one was merged later
                bound, from_left, right = scores[right], False, b[0]

    def best_path(self, part: str) -> list[int]:
        """Ids of a part of a word: one pass over the pieces that end at each position, longest first."""
        n = len(part)
        step: list[int | None] = [None] * (n + 1)  # the last piece of the best path to a position
        begin = [0] * (n + 1)
        if self.merges:
            stays = self.stays
            for last, (size, i) in self.automaton.iter(part):
                end = last + 1
                start = end - size
                if step[end] is not None:
                    continue  # a path of score 0 is there, and there is only one
                if start:
                    left = step[start]
                    if left is None:
                        continue
                    ok = stays.get((left, i))
                    if not (self.stable(left, i) if ok is None else ok):
                        continue
                step[end], begin[end] = i, start
        else:
            best = [0.0] + [NEVER] * n
            hits: list[list] = [[] for _ in range(n + 1)]
            for last, (size, i) in self.automaton.iter(part):
                hits[last + 1].append((size, i, self.scores[i]))
            for end in range(1, n + 1):
                for size, i, score in hits[end] + [(1, self.number(part[end - 1]), self.least - 10)]:
                    if best[end - size] + score > best[end]:
                        best[end], step[end], begin[end] = best[end - size] + score, i, end - size
        if n and step[n] is None:  # a letter that only longer pieces hold
            return self.merged(part)
        out, at = [], n
        while at:
            out.append(step[at])
            at = begin[at]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        """Ids of a run of spaces and a word, part by part."""
        pairs, start, out = self.pairs, 0, []
        for at in [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in pairs] + [len(word)]:
            part, start = word[start:at], at
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) > PARTS:
                    self.parts.clear()
                ids = self._part(part)
                if len(part) <= LONGEST:
                    self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        # Pieces of spaces alone share one score, and which of them merge first depends on the whole run.
        if len(part) == 1:
            numbers = [self.number(part)]
        else:
            numbers = self.merged(part) if self.merges and part.startswith(SPACE * 2) else self.best_path(part)
        out: list[int] = []
        for i in numbers:
            if i < len(self.scores):
                out.append(i)
            else:
                spelled = self.strings[i].encode()
                out += [self.bytes[b] for b in spelled] if self.bytes else [self.unknown]
        return np.array(out, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a space before its first word is added as the model does."""
        plain, spaced = self.known
        if len(plain) + len(spaced) > CACHE:
            plain.clear()
            spaced.clear()
        out = []
        for text in texts:
            found: list[bytes] = []
            text = text.replace(SPACE, " ")
            if self.prefix and text:
                text = " " + text
            if "  " in text or not self.lines:
                found = [self._word(u) for u in UNIT.findall(text.replace(" ", SPACE))]
            else:
                for number, line in enumerate(text.split("\n")):
                    if number:
                        found.append(self._known(plain, "\n", ""))
                    first, *rest = line.split(" ")
                    if first:
                        found.append(self._known(plain, first, ""))
                    for word in rest:
                        ids = spaced.get(word)
                        found.append(self._known(spaced, word, SPACE) if ids is None else ids)
            out.append(np.frombuffer(b"".join(found), self.dtype))
        return out

    def _known(self, known: dict[str, bytes], word: str, before: str) -> bytes:
        ids = known.get(word)
        if ids is None:
            ids = self._word(before + word)
            if len(word) <= LONGEST:
                known[word] = ids
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        text_of = self.text_of
        text = b"".join([text_of[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def model_kind(model: bytes) -> int:
    """1 unigram, 2 BPE: field 3 of the trainer's settings, which are field 2 of the file (protocol buffers)."""
    settings = _field(model, 2)
    kind = _field(settings, 3) if isinstance(settings, bytes) else None
    return kind if isinstance(kind, int) else 1


def _field(data: bytes, wanted: int):
    """The last value of a field at the top level of a message, None if it is missing."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at, found = 0, None
    while at < len(data):
        key, at = varint(at)
        field, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        if field == wanted:
            found = value
    return found


def _codec(model: bytes) -> Codec:
    return worker_state(f"sentencepiece {zlib.crc32(model)}", lambda: Codec(model))


def encode(docs: DataFrame, model: bytes, text: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` without the text, with ``piece_ids`` (array of int) and, if asked, ``same_back``.

    ``model`` is the content of a model file, of a size the vocabulary fixes. A null text is an empty one,
    and an empty one has no ids. ``same_back`` tells whether decoding gives the text again; the sign ▁
    stands for a space in these models, so a text that holds it comes back with spaces. Columns
    of ``docs`` with these names are replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "piece_ids", "same_back")]
    rows = docs.select(*[column(c) for c in keep], whole_text(text).alias("__text"))
    schema = extended(rows.drop("__text").schema, "piece_ids array<int>" + (", same_back boolean" if verify else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in slices(batches):
            texts = batch.column(len(keep)).to_pylist()
            found = codec.encode(texts)
            ends = np.cumsum([0] + [len(x) for x in found])
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            columns = [*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            names = [*keep, "piece_ids"]
            if verify:
                same = [codec.decode(ids) == t.replace(SPACE, " ") for ids, t in zip(found, texts)]
                columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "same_back"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` without its ids, with ``text``; null ids give a null text. A column ``text`` is replaced."""
    keep = [c for c in encoded.columns if c not in (ids, "text")]
    rows = encoded.select(*[column(c) for c in keep], column(ids).alias("__ids"))
    schema = extended(rows.drop("__ids").schema, "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in slices(batches):
            lists = batch.column(len(keep)).to_pylist()
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, schema)
