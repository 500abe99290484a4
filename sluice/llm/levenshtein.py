"""A lexicon trie searched with Levenshtein automata."""

from __future__ import annotations

import re

TRIPLE = re.compile(r"(.)\1\1")


class Trie:
    """Terms as nested dictionaries; the key ``END`` holds the term's number."""

    END = ""

    def __init__(self, terms: dict[str, int]):
        self.top: dict = {}
        for term, number in terms.items():
            node = self.top
            for letter in term:
                node = node.setdefault(letter, {})
            node[self.END] = number


def step(state: tuple, word: str, errors: int, letter: str) -> tuple:
    """The automaton of all strings within ``errors`` edits of ``word``, after one more letter.

    An edit puts a letter in, leaves one out, takes another for it or swaps two neighbours. A state is a set of (letters
    of the word used up, edits made); in the middle of a swap the letters used are ``~used``.
    """
    after = set()
    for used, made in state:
        if used < 0:
            if word[~used] == letter:
                after.add((~used + 2, made))
            continue
        left = word[used : used + 1 + errors - made]
        if left[:1] == letter:
            after.add((used + 1, made))
            continue
        if made < errors:
            after.add((used, made + 1))  # the letter is one too many
            if left:
                after.add((used + 1, made + 1))  # the letter stands for another
            skipped = left.find(letter)
            if skipped > 0:
                after.add((used + skipped + 1, made + skipped))  # letters of the word were left out
            for place in range(1, len(left)):
                if left[place] == letter:  # it came before its neighbour, behind letters left out
                    after.add((~(used + place - 1), made + place))
    return tuple(after)


def nearest(trie: Trie, word: str, errors: int) -> tuple[int, int] | None:
    """(edits, number) of the closest term within ``errors`` edits: the trie walked with the word's automaton."""
    best = None
    todo = [(trie.top, ((0, 0),))]
    while todo:
        node, state = todo.pop()
        for letter, child in node.items():
            if letter == Trie.END:
                edits = min((made + len(word) - used for used, made in state if used >= 0), default=errors + 1)
                if edits <= errors and (best is None or (edits, child) < best):
                    best = (edits, child)
                continue
            after = step(state, word, errors, letter)
            if after:
                todo.append((child, after))
    return best


def errors_for(term: str) -> int:
    """Edits allowed in a term: none below four letters, two from eight on."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


def fewer_errors(term: str) -> int:
    """Edits allowed where ordinary words crowd around a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class Lexicon:
    """Terms with the words that may stand for them.

    ``known`` are ordinary words that lie close to a term: they are no misspellings. Cut into
    ``errors + 1`` pieces, a term keeps one of them in any misspelling: the first at the start, the
    last at the end, or else the middle one a place off at most; a swap across a cut gives the first or the last piece
    one letter of its neighbour. A few lookups by length rule most words out before the tries are walked.
    ``edits`` has what each term allows, by default what its length does.
    """

    # Signs that often stand for letters.
    LOOKALIKES = str.maketrans("0134579@$!|", "oieastgasil")

    def __init__(self, terms: list[str], known: frozenset[str] = frozenset(), edits: tuple[int, ...] | None = None):
        self.terms, self.known = terms, known
        self.edits = edits if edits is not None else tuple(errors_for(t) for t in terms)
        self.exact = {t: i for i, t in enumerate(terms)}
        self.tries = {k: Trie({t: i for i, t in enumerate(terms) if self.edits[i] == k}) for k in (1, 2)}
        # By length of a word: for each of its ranges that may hold a kept piece, the pieces.
        ranges: dict[int, dict[tuple[int, int], set[str]]] = {}
        for term, errors in zip(terms, self.edits):
            size = len(term)
            cuts = [size * i // (errors + 1) for i in range(errors + 2)]
            for n in range(size - errors, size + errors + 1) if errors else ():
                kept = ranges.setdefault(n, {})
                for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    moves = (0,) if i == 0 else (n - size,) if i == errors else (-1, 0, 1)
                    for move in moves:
                        kept.setdefault((start + move, end + move), set()).add(term[start:end])
                first, last, move = cuts[1], cuts[-2], n - size
                kept[0, first].add(term[: first - 1] + term[first])
                kept[last + move, size + move].add(term[last - 1] + term[last + 1 :])
        self.ranges = {n: [(*cut, kept) for cut, kept in found.items()] for n, found in ranges.items()}

    def may_be_near(self, word: str) -> bool:
        """Whether a piece of a term stands where a misspelling of the term keeps it."""
        for start, end, kept in self.ranges.get(len(word), ()):
            if word[start:end] in kept:
                return True
        return False

    def __reduce__(self):  # automata are built anew where they are used
        return Lexicon, (self.terms, self.known, self.edits)

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) for a lower-case word, None for an ordinary one."""
        if word in self.exact:
            return 0, self.exact[word]
        if len(word) < 3 or word in self.known:
            return None
        found = None
        forms = (word,)
        if not word.isalpha() or TRIPLE.search(word):
            forms = tuple(dict.fromkeys((word, _plain(word.translate(self.LOOKALIKES)))))
        for form in forms:
            if form in self.exact:
                return 1, self.exact[form]
            for errors, trie in self.tries.items() if self.may_be_near(form) else ():
                near = nearest(trie, form, errors)
                if near and (found is None or near < found):
                    found = near
        return (max(1, found[0]), found[1]) if found else None


def _plain(word: str) -> str:
    """Runs of three and more equal letters, and signs between letters, taken out."""
    out = []
    for letter in word:
        if letter.isalnum() and not (len(out) > 1 and out[-1] == out[-2] == letter):
            out.append(letter)
    return "".join(out)
