"""Language-model scores from a sharded Elias-Fano n-gram trie.

Documents are read once, into groups of a few million tokens that carry their distinct words and
bigrams as arrays. A group sends its distinct n-grams, with training counts, to shards by hash;
each shard sums the counts, builds its trie in memory-mapped files, answers every group's n-grams
from it, and the answers go back. So the model is never in one place, is never broadcast, and grows
with the corpus; what moves is arrays of distinct n-grams, not tokens.

The model interpolates bigrams, with absolute discounting, and the add-one unigrams of the base.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.names import column
from sluice.llm.common import hold, slices, whole_text
from sluice.llm.eliasfano import Trie

GROUP_TOKENS = 3 << 19
SHARD_ENTRIES = 1 << 20  # distinct n-grams that groups send to a shard, at most about
HOT_SHARE = 1024  # contexts with more than one in so many tokens are dealt to all shards by their successors
DISCOUNT = 0.75  # taken off each bigram's count, the usual value for words; the same for all shards and corpus sizes
WORD_BITS = 40  # of a successor's hash that are sent
STEP = 1024  # steps of a quantised log10 probability in one unit
BEGIN, END = xxhash.xxh64_intdigest(b" begin"), xxhash.xxh64_intdigest(b" end")  # no word has a space

GROUPS = "grp string, doc_ids array<bigint>, learns array<boolean>, lengths array<int>, n_learned bigint, words binary, word_counts binary, places binary, tokens binary, n_tokens bigint"


def _packed(values: np.ndarray, dtype: str) -> bytes:
    return values.astype(dtype).tobytes()


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses far better."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class _Group:
    """Documents read so far, as numbers of their words."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.learns, self.texts, self.tokens = [], [], [], 0

    def add(self, doc_id: int | None, learns: bool, text: str) -> None:
        numbers = self.numbers
        words = text.encode().lower().split()  # on bytes: A-Z and the white space of ASCII
        self.texts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.learns.append(learns)
        self.tokens += len(words) + 1

    def row(self) -> dict:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.numbers), np.uint64, len(self.numbers))
        words = np.unique(np.concatenate([hashes, np.array([BEGIN, END], np.uint64)]))
        # Words are numbered as they appear, so frequent ones have small numbers, which compress well.
        row = {
            "grp": uuid.uuid4().hex,
            "doc_ids": self.ids,
            "learns": self.learns,
            "lengths": [len(t) + 1 for t in self.texts],
            "words": _packed(words, "<u8"),
            "places": _planes(np.searchsorted(words, hashes)),
            "tokens": _planes(np.concatenate(self.texts)),
            "n_tokens": self.tokens,
        }
        _, tokens, learned = _unfold(row)
        row["n_learned"] = int(learned.sum())
        row["word_counts"] = _packed(np.bincount(tokens[learned], minlength=len(words)), "<u4")
        return row


def _unfold(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before each token, the token, both as places among the group's words, and whether it is learned from."""
    words = np.frombuffer(row["words"], "<u8")
    begin, end = (int(np.searchsorted(words, np.uint64(h))) for h in (BEGIN, END))
    lengths = np.array(row["lengths"], np.int64)
    last = np.cumsum(lengths) - 1
    tokens = np.full(int(lengths.sum()), end, np.int64)
    inner = np.ones(len(tokens), bool)
    inner[last] = False
    tokens[inner] = _from_planes(row["places"])[_from_planes(row["tokens"])]
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[last - lengths + 1] = begin
    return before, tokens, np.repeat(np.array(row["learns"], bool), lengths)


def read_groups(docs: DataFrame, learn: Column, text: str, doc_id: str) -> DataFrame:
    schema = pa.schema(
        [
            ("grp", pa.string()),
            ("doc_ids", pa.list_(pa.int64())),
            ("learns", pa.list_(pa.bool_())),
            ("lengths", pa.list_(pa.int32())),
            ("n_learned", pa.int64()),
            *[(n, pa.binary()) for n in ("words", "word_counts", "places", "tokens")],
            ("n_tokens", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group()
        for batch in slices(batches):
            for one, learns, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                group.add(one, learns, words)
                if group.tokens >= GROUP_TOKENS:
                    yield pa.RecordBatch.from_pylist([group.row()], schema)
                    group = _Group()
        if group.ids:
            yield pa.RecordBatch.from_pylist([group.row()], schema)

    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, GROUPS)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard that a hash's upper bits name; ``shards`` is a power of two."""
    return (hashes >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)


def _pair_shard(contexts: np.ndarray, successors: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the context, but a frequent context's successors are dealt by their own hash."""
    mixed = contexts ^ (successors * np.uint64(0x9E3779B97F4A7C15))
    return _shard(np.where(np.isin(contexts, hot), mixed, contexts), shards)


def _power_of_two(entries: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, entries / SHARD_ENTRIES))))


# --- Unigrams --------------------------------------------------------------------------------------

ASKED = "shard int, grp string, first binary, runs binary, second binary, counts binary"
ASKED_ARROW = pa.schema(
    [("shard", pa.int32()), ("grp", pa.string()), ("first", pa.binary()), ("runs", pa.binary()), ("second", pa.binary()), ("counts", pa.binary())]
)
ANSWER = "grp string, kind string, shard int, first binary, second binary, kinds bigint, hot array<bigint>, amounts array<double>"
ANSWER_ARROW = pa.schema(
    [
        ("grp", pa.string()),
        ("kind", pa.string()),
        ("shard", pa.int32()),
        ("first", pa.binary()),
        ("second", pa.binary()),
        ("kinds", pa.int64()),
        ("hot", pa.list_(pa.int64())),
        ("amounts", pa.list_(pa.float64())),
    ]
)


def ask_words(groups: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, counts = np.frombuffer(words, "<u8"), np.frombuffer(counts, "<u4")
                of = _shard(words, shards)  # ascending, as the words are
                for shard in np.unique(of).tolist():
                    a, b = np.searchsorted(of, [shard, shard + 1])
                    row = {"shard": shard, "grp": grp, "first": _packed(words[a:b], "<u8"), "counts": _packed(counts[a:b], "<u4")}
                    yield pa.RecordBatch.from_pylist([row], ASKED_ARROW)

    return groups.select("grp", "words", "word_counts").mapInArrow(run, ASKED)


def answer_words(asked: DataFrame, hot_count: int) -> DataFrame:
    """Each group's words with their counts over all training tokens; each shard also tells how many it has and its hot ones."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked_words = [np.frombuffer(r["first"], "<u8") for r in rows]
        words, inverse = np.unique(np.concatenate(asked_words), return_inverse=True)
        sums = np.zeros(len(words), np.int64)
        np.add.at(sums, inverse, np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.int64))
        found, at = sums[inverse], 0
        shard = rows[0]["shard"]
        hot = sums > hot_count
        out = [{"kind": "told", "shard": shard, "kinds": int((sums > 0).sum()), "hot": words[hot].view(np.int64).tolist(), "amounts": sums[hot].astype(float).tolist()}]
        for row, own in zip(rows, asked_words):
            out.append({"grp": row["grp"], "kind": "words", "shard": shard, "first": _packed(found[at : at + len(own)], "<i8")})
            at += len(own)
        return pa.Table.from_pylist(out, ANSWER_ARROW)

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


# --- Bigrams ---------------------------------------------------------------------------------------


def _pairs(keys: np.ndarray, words: np.ndarray, hot: np.ndarray, shards: int):
    """A group's bigrams as hashes, each one's shard, and the order in which they are sent."""
    first, second = words[keys // len(words)], words[keys % len(words)]
    of = _pair_shard(first, second, hot, shards)
    return first, second, of, np.argsort(of, kind="stable")


def _run_starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def ask_pairs(groups: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                grp, words = row["grp"], np.frombuffer(row["words"], "<u8")
                before, tokens, learned = _unfold(row)
                keys = before * len(words) + tokens
                own, counts = np.unique(keys[learned], return_counts=True)
                keys = np.unique(keys)
                counts = _spread(keys, own, counts)
                del before, tokens, learned
                first, second, of, order = _pairs(keys, words, hot, shards)
                sent = of[order]
                for shard in np.unique(sent).tolist():
                    a, b = np.searchsorted(sent, [shard, shard + 1])
                    at = order[a:b]
                    starts = _run_starts(first[at])
                    small = counts[at].max(initial=0) < 256
                    row = {
                        "shard": shard,
                        "grp": grp,
                        "first": _packed(first[at[starts]], "<u8"),
                        "runs": _packed(np.diff(np.append(starts, len(at))), "<u4"),
                        "second": (second[at] >> np.uint64(64 - WORD_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8].tobytes(),
                        "counts": _packed(counts[at], "u1" if small else "<u4"),
                    }
                    yield pa.RecordBatch.from_pylist([row], ASKED_ARROW)

    return groups.select("grp", "learns", "lengths", "words", "places", "tokens").mapInArrow(run, ASKED)


def _spread(keys: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of some of the sorted keys, zero for the others."""
    out = np.zeros(len(keys), np.int64)
    out[np.searchsorted(keys, own)] = counts
    return out


def build_trie(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, discount: float, hot: np.ndarray, hot_totals: np.ndarray) -> Trie:
    """The trie of a shard's bigrams (repeats are summed) with discounted, quantised probabilities.

    A context's weight is the probability, times its count, that its discounted successors leave to unigrams.
    """
    seen = counts > 0
    contexts, of = np.unique(contexts[seen], return_inverse=True)
    words, successor = np.unique(words[seen], return_inverse=True)
    pairs, inverse = np.unique(of * max(1, len(words)) + successor, return_inverse=True)
    sums = np.bincount(inverse, weights=counts[seen], minlength=len(pairs)) if len(pairs) else np.zeros(0)
    of, successor = pairs // max(1, len(words)), pairs % max(1, len(words))
    totals = np.bincount(of, weights=sums, minlength=len(contexts))
    if len(hot):
        place = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
        totals = np.where(hot[place] == contexts, hot_totals[place], totals)
    codes = quantise((sums - discount) / totals[of]) if len(pairs) else np.zeros(0, np.uint16)
    weights = (discount * np.bincount(of, minlength=len(contexts))).astype(np.float32)
    return Trie.build(contexts, words, of, successor, codes, weights)


def quantise(probabilities: np.ndarray) -> np.ndarray:
    """16-bit codes in equal steps of the logarithm; 0 stays for what is not held."""
    steps = np.round(-np.log10(probabilities) * STEP)
    return (np.clip(steps, 0, 65534) + 1).astype(np.uint16)


def unquantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(float) - 1) / STEP), 0.0)


def answer_pairs(asked: DataFrame, discount: float, hot: np.ndarray, hot_totals: np.ndarray) -> DataFrame:
    """Each group's bigrams with their quantised probabilities, and its contexts with their weights."""
    width = WORD_BITS // 8

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked_contexts, contexts, words, counts = [], [], [], []
        for r in rows:
            own, runs = np.frombuffer(r["first"], "<u8"), np.frombuffer(r["runs"], "<u4")
            asked_contexts.append((own, runs))
            contexts.append(np.repeat(own, runs))
            parts = np.zeros((int(runs.sum()), 8), np.uint8)
            parts[:, :width] = np.frombuffer(r["second"], np.uint8).reshape(-1, width)
            words.append(parts.view("<u8").reshape(-1))
            counts.append(np.frombuffer(r["counts"], "u1" if len(r["counts"]) == len(parts) else "<u4").astype(np.int64))
        out = []
        with tempfile.TemporaryDirectory() as folder:
            build_trie(np.concatenate(contexts), np.concatenate(words), np.concatenate(counts), discount, hot, hot_totals).save(folder)
            del contexts, counts
            trie = Trie.load(folder)
            for r, (own, runs), sent in zip(rows, asked_contexts, words):
                place = trie.context(own)
                codes = trie.lookup(np.repeat(place, runs), sent)
                weights = np.where(place >= 0, trie.weights[np.maximum(place, 0)] if trie.contexts.size else 0, 0)
                out.append({"grp": r["grp"], "kind": "pairs", "shard": r["shard"], "first": _packed(codes, "<u2"), "second": _packed(weights, "<f4")})
            place = trie.context(hot)
            amounts = np.where(place >= 0, trie.weights[np.maximum(place, 0)] if trie.contexts.size else 0, 0)
            out.append({"kind": "told", "shard": rows[0]["shard"], "amounts": amounts.astype(float).tolist()})
        return pa.Table.from_pylist(out, ANSWER_ARROW)

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


# --- Scores ----------------------------------------------------------------------------------------

SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
SCORES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def _scores(group: dict, answers: list[dict], total: int, kinds: int, hot: np.ndarray, hot_weights: np.ndarray, shards: int) -> pa.Table:
    words = np.frombuffer(group["words"], "<u8")
    counts = np.concatenate([np.frombuffer(r["first"], "<i8") for r in sorted((r for r in answers if r["kind"] == "words"), key=lambda r: r["shard"])])
    unigram = (counts + 1) / (total + kinds + 1)
    before, tokens, _ = _unfold(group)
    keys, stream = np.unique(before * len(words) + tokens, return_inverse=True)
    del before
    context, successor = keys // len(words), keys % len(words)
    first, _, of, order = _pairs(keys, words, hot, shards)
    sent, codes, weights = of[order], np.zeros(len(order), np.uint16), np.zeros(len(words))
    for r in (r for r in answers if r["kind"] == "pairs"):
        a, b = np.searchsorted(sent, [r["shard"], r["shard"] + 1])
        at = order[a:b]
        codes[at] = np.frombuffer(r["first"], "<u2")
        weights[context[at[_run_starts(first[at])]]] = np.frombuffer(r["second"], "<f4")
    # A hot context has a part of its weight in every shard: their sum counts.
    place = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    weights = np.where(hot[place] == words, hot_weights[place], weights)
    begin, end = (int(np.searchsorted(words, np.uint64(h))) for h in (BEGIN, END))
    follows = counts.copy()
    follows[begin], follows[end] = counts[end], 0  # as many texts begin as end
    left = np.where(follows > 0, weights / np.maximum(follows, 1), 1.0)
    pair = np.log10(unquantise(codes) + left[context] * unigram[successor])
    lengths = np.array(group["lengths"], np.int64)
    starts = np.cumsum(lengths) - lengths
    columns = [
        group["doc_ids"],
        lengths,
        np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts),
        np.full(len(lengths), total, np.int64),
        np.add.reduceat(np.log10(unigram)[tokens], starts),
        np.add.reduceat(pair[stream], starts),
    ]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORES_ARROW)], schema=SCORES_ARROW)


def lm_scores(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", discount: float = DISCOUNT) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The model is learned from the rows where ``learn`` is true. Tokens are the words, lower-cased in A-Z,
    and one end. A null text is an empty one, of one token, the end. Repeated rows are scored, and learned
    from, as often as they occur; a null id is returned as one. An empty table gives an empty
    result. Without a row to learn from all counts are zero. ``discount``, between 0 and 1, is the same for every
    bigram, so scores do not depend on how many shards there are.
    """
    if not 0 < discount < 1:
        raise ValueError("discount must lie between 0 and 1")
    groups = hold(read_groups(docs, learn, text, doc_id), "lm-groups")
    learned = F.size(F.filter("learns", lambda x: x))
    sizes = groups.agg(F.sum("n_learned"), F.sum(F.octet_length("words") / 8), F.sum("n_tokens"), F.sum(learned)).first()
    total, n_words, n_tokens, n_texts = (int(x or 0) for x in sizes)
    word_shards, pair_shards = _power_of_two(n_words), _power_of_two(n_tokens)
    word_answers = hold(answer_words(ask_words(groups, word_shards), max(1, total // HOT_SHARE)), "lm-words")
    told = word_answers.where("kind = 'told'")
    kinds = told.agg(F.sum("kinds")).first()[0] or 0
    # Fewer than HOT_SHARE words are hot, whatever the corpus.
    frequent = {r.word: r.n for r in told.select(F.explode(F.arrays_zip(F.col("hot").alias("word"), F.col("amounts").alias("n"))).alias("h")).select("h.word", "h.n").collect()}
    frequent[int(np.uint64(BEGIN).astype(np.int64))] = float(n_texts)
    hot = np.array(sorted(np.array(list(frequent), np.int64).view(np.uint64).tolist()), np.uint64)
    hot_totals = np.array([frequent[int(h)] for h in hot.view(np.int64)])
    pair_answers = hold(answer_pairs(ask_pairs(groups, hot, pair_shards), discount, hot, hot_totals), "lm-pairs")
    parts = pair_answers.where("kind = 'told'").select(F.posexplode("amounts").alias("at", "amount")).groupBy("at").agg(F.sum("amount").alias("amount"))
    hot_weights = np.zeros(len(hot))
    for r in parts.collect():
        hot_weights[r["at"]] = r["amount"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        group = next(r for r in rows if r["kind"] == "group")
        return _scores(group, rows, total, kinds, hot, hot_weights, pair_shards)

    whole = groups.select("grp", F.lit("group").alias("kind"), "doc_ids", "learns", "lengths", "words", "places", "tokens")
    answers = word_answers.where("kind = 'words'").union(pair_answers.where("kind = 'pairs'")).select("grp", "kind", "shard", "first", "second")
    return whole.unionByName(answers, allowMissingColumns=True).groupBy("grp").applyInArrow(run, SCORES)
