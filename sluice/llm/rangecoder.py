"""An adaptive context-mixing range coder for token ids, many lanes at a time.

A block is reset and checked by itself. Its ids are laid out in lanes of ``LANE`` ids that are coded side
by side, one step of all lanes after the other, so every step is a few array operations. The model is
shared by the lanes and learns after each step, the same way in both directions:

* order 2: the id last seen after the two ids before, with a confidence;
* order 1: the id last seen after the one id before, with a confidence;
* order 0: the frequencies of all ids in the block so far.

The confidences' hit rates in the block so far mix the three: an id's interval is the order-2
prediction's share, or the order-1 prediction's, or its part of what they leave to order 0.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANE = 128
LANES = 4096
BLOCK = LANE * LANES  # ids of a block at most
BITS = 28  # of a step's total frequency
TOTAL = 1 << BITS
FLOOR = 64  # frequency of an id that has not been seen
COARSE = 12  # bits of a place that the first lookup of an id leaves open
MOST = TOTAL // 32 * 31  # share of both predictions at most
SLOTS = 1 << 18  # contexts of order 2
SURE = 15  # the highest confidence
MAGIC = b"IDR1"
U = np.uint64


#: The next confidence after a miss and after a hit, by the present one.
NEXT = np.array([[1, 1, *[c >> 1 for c in range(2, SURE + 1)]], [min(c + 1, SURE) for c in range(SURE + 1)]]).reshape(-1)


class _Model:
    """Products with booleans stand for choices here: they are several times as fast as np.where."""

    def __init__(self, vocabulary: int, lanes: int, decoding: bool = False):
        self.vocabulary, self.decoding = vocabulary, decoding
        self.counts = np.zeros(vocabulary, np.int64)
        self.guess = [np.zeros(vocabulary + 1, np.int64), np.zeros(SLOTS, np.int64)]
        self.sure = [np.zeros(vocabulary + 1, np.int64), np.zeros(SLOTS, np.int64)]
        self.hits = [np.zeros(SURE + 1, np.int64), np.zeros(SURE + 1, np.int64)]
        self.tries = [np.full(SURE + 1, 2), np.full(SURE + 1, 2)]
        self.last, self.prior = np.full(lanes, vocabulary, np.int64), np.full(lanes, vocabulary, np.int64)
        self.step = 0
        self._refresh()

    def _refresh(self) -> None:
        """The cumulative frequencies and, which only a decoder needs, the last id that starts at or before each 4096th of the total."""
        free = TOTAL - FLOOR * self.vocabulary
        frequencies = FLOOR + self.counts * free // max(1, int(self.counts.sum()))
        self.sums = np.concatenate([[0], np.cumsum(frequencies)])
        if self.decoding:
            # How many sums lie at or before a place: counted at the first place that each of them does not pass.
            reached = np.bincount(self.sums + (1 << COARSE) - 1 >> COARSE, minlength=(TOTAL >> COARSE) + 1)
            self.first = np.cumsum(reached[: (TOTAL >> COARSE) + 1]) - 1

    def predict(self) -> None:
        """Each lane's two guesses and their shares of the total."""
        self.slots = (self.last, (self.last * 0x9E3779B1 + self.prior * 0x85EBCA77 >> 7) & (SLOTS - 1))
        self.trust = [sure.take(slot) for sure, slot in zip(self.sure, self.slots)]
        self.one, self.two = (guess.take(slot) for guess, slot in zip(self.guess, self.slots))
        rates = [hits * (MOST // 256) // tries * 256 for hits, tries in zip(self.hits, self.tries)]
        rates[0][0] = rates[1][0] = 0  # no guess yet
        self.share_two = rates[1].take(self.trust[1])
        share_one = (MOST - self.share_two) * (rates[0].take(self.trust[0]) >> 8) >> (BITS - 8)
        self.share_one = share_one * (self.one != self.two)
        self.guessed = self.share_two + self.share_one
        self.rest = TOTAL - self.guessed

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's id."""
        low = self.sums.take(ids) * self.rest >> BITS
        high = self.sums.take(ids + 1) * self.rest >> BITS
        is_two = (ids == self.two) & (self.share_two > 0)
        is_one = (ids == self.one) & (self.share_one > 0) & ~is_two
        other = ~(is_two | is_one)
        start = is_one * self.share_two + other * (self.guessed + low)
        return start, is_two * self.share_two + is_one * self.share_one + other * (high - low)

    def identify(self, values: np.ndarray) -> np.ndarray:
        """The id whose interval holds each lane's value."""
        place = ((np.maximum(values - self.guessed, 0) + 1 << BITS) - 1) // self.rest
        place = np.minimum(place, TOTAL - 1)
        bucket = place >> COARSE
        ids, last = self.first.take(bucket), self.first.take(bucket + 1)
        while len(open_ := np.flatnonzero(ids < last)):
            middle = (ids[open_] + last[open_] + 1) // 2
            reached = self.sums[middle] <= place[open_]
            ids[open_] += reached * (middle - ids[open_])
            last[open_] -= ~reached * (last[open_] - middle + 1)
        ids = np.minimum(ids, self.vocabulary - 1)
        is_two, is_one = values < self.share_two, (values >= self.share_two) & (values < self.guessed)
        return is_two * self.two + is_one * self.one + ~(is_two | is_one) * ids

    def learn(self, ids: np.ndarray) -> None:
        for k, guess in ((0, self.one), (1, self.two)):
            right, trust, slot = ids == guess, self.trust[k], self.slots[k]
            self.tries[k] += np.bincount(trust, minlength=SURE + 1)
            self.hits[k] += np.bincount(trust * right, minlength=SURE + 1)
            # Of lanes that share a context, the last one decides. A guess in doubt gives way.
            stays = right | (trust > 1)
            self.guess[k][slot] = ids + stays * (guess - ids)
            self.sure[k][slot] = NEXT.take(right * (SURE + 1) + trust)
        np.add.at(self.counts, ids, 1)
        self.last, self.prior = ids, self.last
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 32 == 0:
            self._refresh()


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A header with sizes and the checksum of the ids, the lanes' lengths, and the lanes."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) > BLOCK:
        raise ValueError(f"a block holds {BLOCK} ids at most")
    lanes = -(-len(ids) // LANE)
    grid = np.zeros(lanes * LANE, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, LANE)
    model = _Model(vocabulary, lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    room = 4 * LANE + 8
    out = np.zeros(lanes * room, "<u2")
    ends = np.arange(lanes) * room

    def emit(at: np.ndarray) -> None:
        first = low[at]
        out[ends[at]] = first >> U(48)
        ends[at] += 1
        low[at] = first << U(16)

    for step in range(LANE if lanes else 0):
        model.predict()
        start, width = model.interval(grid[:, step])
        part = span >> U(BITS)
        low += part * start.astype(U)
        span = part * width.astype(U)
        while len(at := _ready(low, span)):
            emit(at)
            span[at] <<= U(16)
        model.learn(grid[:, step])
    for _ in range(4 if lanes else 0):
        emit(np.arange(lanes))
    head = MAGIC + struct.pack("<IIII", len(ids), vocabulary, lanes, zlib.crc32(ids.tobytes()))
    ends -= np.arange(lanes) * room
    body = out.reshape(lanes, room)[np.arange(room) < ends[:, None]].tobytes() if lanes else b""
    return head + ends.astype("<u2").tobytes() + body


def _ready(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The lanes whose upper 16 bits are settled; a span that became too small is cut to settle them."""
    open_ = (low ^ (low + span)) >> U(48) != 0
    small = open_ & (span < U(1 << 40))
    if small.any():
        span[small] = (~low[small] + U(1)) & U((1 << 40) - 1)
    return np.flatnonzero(~open_ | small)


class DamagedBlock(ValueError):
    """The checksum or the layout of a block does not fit."""


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; raises if it is damaged."""
    if data[:4] != MAGIC or len(data) < 20:
        raise DamagedBlock("no block of ids")
    n, vocabulary, lanes, check = struct.unpack("<IIII", data[4:20])
    if lanes != -(-n // LANE) or len(data) < 20 + 2 * lanes:
        raise DamagedBlock("sizes do not fit")
    lengths = np.frombuffer(data, "<u2", lanes, 20).astype(np.int64)
    if 20 + 2 * lanes + 2 * int(lengths.sum()) != len(data):
        raise DamagedBlock("sizes do not fit")
    words = np.append(np.frombuffer(data, "<u2", offset=20 + 2 * lanes).astype(U), np.zeros(8, U))
    at = np.cumsum(lengths) - lengths
    model = _Model(vocabulary, lanes, decoding=True)
    grid = np.zeros((lanes, LANE), np.int64)
    low, span, code = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U), np.zeros(lanes, U)
    for _ in range(4 if lanes else 0):
        code = code << U(16) | words[at]
        at += 1
    for step in range(LANE if lanes else 0):
        model.predict()
        part = span >> U(BITS)
        values = np.minimum((code - low) // part, U(TOTAL - 1)).astype(np.int64)
        ids = model.identify(values)
        start, width = model.interval(ids)
        low += part * start.astype(U)
        span = part * width.astype(U)
        if not span.all():
            raise DamagedBlock("an id without an interval")
        while len(ready := _ready(low, span)):
            code[ready] = code[ready] << U(16) | words[np.minimum(at[ready], len(words) - 1)]
            at[ready] += 1
            low[ready] <<= U(16)
            span[ready] <<= U(16)
        grid[:, step] = ids
        model.learn(ids)
    ids = grid.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != check:
        raise DamagedBlock("the checksum does not fit")
    return ids
