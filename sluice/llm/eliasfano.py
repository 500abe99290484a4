"""Elias-Fano sequences and a two-level n-gram trie on them, read from memory-mapped files."""

from __future__ import annotations

import os

import numpy as np

BLOCK = 1 << 16  # queries that are answered together


class EliasFano:
    """A monotone sequence: the low bytes of each value, and the rest in unary as a bit vector.

    The low parts take whole bytes, so a high part is shared by 256 values at most on average and a
    successor is found by the high part's zero, then by halving among the values that share it.
    """

    def __init__(self, size: int, low_bytes: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.size, self.low_bytes, self.low, self.high, self.zeros = size, low_bytes, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bytes = 0
        while n and (top >> (8 * low_bytes)) > n and low_bytes < 8:
            low_bytes += 1
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low_bytes].copy()
        parts = (values >> np.uint64(8 * low_bytes)) if low_bytes < 8 else np.zeros(n, np.uint64)
        length = n + int(parts[-1] if n else 0) + 2
        bits = np.zeros((length + 63) // 64 * 64, np.uint8)
        bits[parts.astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        # Zeros before each word of 64 bits: the directory of the search for a zero.
        ones = np.bitwise_count(high.view(np.uint64)).astype(np.int64)
        zeros = np.arange(len(ones)) * 64 - np.concatenate([[0], np.cumsum(ones)[:-1]])
        return cls(n, low_bytes, low, high, zeros.astype(np.int64))

    def save(self, folder: str, name: str) -> None:
        for part in ("low", "high", "zeros"):
            np.save(os.path.join(folder, f"{name}.{part}.npy"), getattr(self, part))
        np.save(os.path.join(folder, f"{name}.size.npy"), np.array([self.size, self.low_bytes]))

    @classmethod
    def load(cls, folder: str, name: str) -> EliasFano:
        def part(kind: str) -> np.ndarray:
            path = os.path.join(folder, f"{name}.{kind}.npy")
            array = np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)
            return array

        size, low_bytes = part("size").tolist()
        return cls(size, low_bytes, part("low"), part("high"), part("zeros"))

    def _before(self, parts: np.ndarray) -> np.ndarray:
        """How many values have a high part below each of ``parts``."""
        wanted = np.minimum(parts, np.uint64(1 << 62)).astype(np.int64) - 1  # number of the zero that ends the part before
        total = int(len(self.zeros) * 64 - self.size)
        out = np.where(wanted < 0, 0, self.size)
        seek = np.flatnonzero((wanted >= 0) & (wanted < total))
        word = np.searchsorted(self.zeros, wanted[seek], "right") - 1
        words = np.asarray(self.high).view(np.uint64)[word]
        free = 1 - np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rank = (wanted[seek] - self.zeros[word]).astype(np.uint8)
        place = np.argmax(np.cumsum(free, axis=1, dtype=np.uint8) > rank[:, None], axis=1)
        out[seek] = np.minimum(word * 64 + place - wanted[seek], self.size)
        return out

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        rows = self.low[at]
        for i in range(self.low_bytes):
            out |= rows[:, i].astype(np.uint64) << np.uint64(8 * i)
        return out

    def successors(self, values: np.ndarray) -> np.ndarray:
        """The place of the first element not below each value; the size where there is none."""
        return np.concatenate([np.zeros(0, np.int64)] + [self._some(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK)])

    def _some(self, values: np.ndarray) -> np.ndarray:
        values = values.astype(np.uint64)
        shift = np.uint64(8 * self.low_bytes)
        parts = values >> shift if self.low_bytes < 8 else np.zeros(len(values), np.uint64)
        rest = values & np.uint64((1 << (8 * self.low_bytes)) - 1)
        first, last = self._before(parts), self._before(parts + np.uint64(1))
        while len(open_ := np.flatnonzero(first < last)):
            middle = (first[open_] + last[open_]) // 2
            below = self._low(middle) < rest[open_]
            first[open_] = np.where(below, middle + 1, first[open_])
            last[open_] = np.where(below, last[open_], middle)
        return first

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at some places, each found by its one in the bit vector."""
        return np.concatenate([np.zeros(0, np.uint64)] + [self._values(places[i : i + BLOCK]) for i in range(0, len(places), BLOCK)])

    def _values(self, places: np.ndarray) -> np.ndarray:
        before = np.arange(len(self.zeros)) * 64 - self.zeros  # ones before each word
        word = np.searchsorted(before, places, "right") - 1
        words = np.asarray(self.high).view(np.uint64)[word]
        ones = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rank = (places - before[word]).astype(np.uint8)
        place = np.argmax(np.cumsum(ones, axis=1, dtype=np.uint8) > rank[:, None], axis=1)
        parts = (word * 64 + place - places).astype(np.uint64)
        return (parts << np.uint64(8 * self.low_bytes) if self.low_bytes < 8 else np.uint64(0)) | self._low(places)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is not held."""
        if not self.size:
            return np.full(len(values), -1)
        places = self.successors(values)
        held = places < self.size
        held[held] = self.at(places[held]) == values[held].astype(np.uint64)
        return np.where(held, places, -1)


class Trie:
    """Contexts, the range of each one's successors, and the successors as ids relative to their context.

    A successor's id is its word's rank in the shard; adding the context's rank times the number of words
    keeps the whole level monotone. Each successor has a quantised probability, each context a weight.
    """

    LEVELS = ("words", "contexts", "pointers", "successors")

    def __init__(self, words, contexts, pointers, successors, codes, weights):
        self.words, self.contexts, self.pointers, self.successors = words, contexts, pointers, successors
        self.codes, self.weights = codes, weights

    @classmethod
    def build(cls, contexts: np.ndarray, words: np.ndarray, of: np.ndarray, successors: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> Trie:
        """``contexts`` and ``words`` sorted; ``of`` and ``successors`` are ranks in them, sorted pairwise."""
        starts = np.searchsorted(of, np.arange(len(contexts) + 1))
        keys = of.astype(np.uint64) * np.uint64(max(1, len(words))) + successors.astype(np.uint64)
        levels = [EliasFano.build(x) for x in (words, contexts, starts, keys)]
        return cls(*levels, codes, weights)

    def save(self, folder: str) -> None:
        for name in self.LEVELS:
            getattr(self, name).save(folder, name)
        np.save(os.path.join(folder, "codes.npy"), self.codes)
        np.save(os.path.join(folder, "weights.npy"), self.weights)

    @classmethod
    def load(cls, folder: str) -> Trie:
        levels = [EliasFano.load(folder, name) for name in cls.LEVELS]
        arrays = [np.load(os.path.join(folder, f"{x}.npy"), mmap_mode="r" if levels[0].size else None) for x in ("codes", "weights")]
        return cls(*levels, *arrays)

    def context(self, hashes: np.ndarray) -> np.ndarray:
        return self.contexts.find(hashes)

    def lookup(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each pair of a context's place and a word's hash; zero where the trie has none."""
        out = np.zeros(len(words), self.codes.dtype)
        known, inverse = np.unique(words, return_inverse=True)
        rank = self.words.find(known)[inverse]
        seek = np.flatnonzero((context >= 0) & (rank >= 0))
        of = context[seek]
        keys = of.astype(np.uint64) * np.uint64(max(1, self.words.size)) + rank[seek].astype(np.uint64)
        places = self.successors.successors(keys)
        # The successor must lie in its context's range and be the word itself.
        ends = self.pointers.at(of + 1).astype(np.int64)
        inside = np.flatnonzero(places < ends)
        inside = inside[self.successors.at(places[inside]) == keys[inside]]
        out[seek[inside]] = self.codes[places[inside]]
        return out
