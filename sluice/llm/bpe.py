"""Byte-level BPE with the tokenizers library, remembering the ids of words.

Pre-tokens of this vocabulary never hold a character followed by white space, and matching looks ahead
only. So a text cut before each run of white space has the same pre-tokens part by part, and the ids of a
part do not depend on its neighbours: equal parts are encoded once per worker.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

CACHE = 600_000  # parts that a worker remembers
JOINED = 1024  # new words that are encoded together
LONGEST = 64  # characters of a part that is remembered
# The characters that Unicode calls white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PART = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
RUN = re.compile(f"[{SPACE}][{SPACE}]")


class Encoder:
    """Ids of whole texts; ``definition`` is the text of a tokenizer file without normalizer or added prefix.

    With ``added``, the strings of added tokens get their own ids wherever they stand, as the library does it;
    without, they are ordinary text. They hold no white space, so each lies inside one part.
    """

    def __init__(self, definition: str, added: bool = False):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not added
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        # Bytes that each id stands for: this vocabulary spells every byte as one character.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for spelled, number in self.tokenizer.get_vocab().items():
            self.sizes[number] = len(spelled)
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            if added and (token.lstrip or token.rstrip or any(c in SPACE for c in token.content)):
                raise ValueError(f"the added token {token.content!r} takes white space, which parts are cut at")
            self.sizes[number] = len(token.content.encode())

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text cut before white space; a single line break is a part of its own."""
        if RUN.search(text):
            return PART.findall(text)
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + word for word in rest]
            out.append("\n")
        out.pop()
        return out

    def trim(self) -> None:
        """Forget, when much is remembered."""
        if len(self.known) > CACHE:
            self.known.clear()

    def learn(self, parts: set[str]) -> None:
        """Remember the ids of new parts. Words after a space are encoded many at a time and cut by their bytes."""
        spaced = [p for p in parts if p[0] == " " and len(p) > 1 and not RUN.match(p)]
        joined = [spaced[i : i + JOINED] for i in range(0, len(spaced), JOINED)]
        for some, found in zip(joined, self._ids(["".join(some) for some in joined])):
            sizes = np.fromiter((len(p.encode()) for p in some), np.int64, len(some))
            ends = np.searchsorted(np.cumsum(self.sizes[found]), np.cumsum(sizes)) + 1
            data, width = found.tobytes(), found.itemsize
            cuts = (ends * width).tolist()
            self.known.update((p, data[a:b]) for p, a, b in zip(some, [0, *cuts], cuts))
        others = [p for p in parts if not (p[0] == " " and len(p) > 1 and not RUN.match(p))]
        self.known.update((p, ids.tobytes()) for p, ids in zip(others, self._ids(others)))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes of ``dtype``."""
        cut = [self.parts(t) for t in texts]
        known = self.known
        self.trim()
        self.learn({p for parts in cut for p in parts if p not in known})
        out = [b"".join([known[p] for p in parts]) for parts in cut]
        for p in [p for parts in cut for p in parts if len(p) > LONGEST]:
            known.pop(p, None)
        return out
