"""Toxicity scores from a learned lexicon, its misspellings and their context.

The lexicon is learned from labelled rows: words far more frequent in toxic texts than chance allows.
Misspelled terms are found by walking the lexicon's trie with each word's Levenshtein automaton.
The context of a hit, in a window of words, tells quotation from abuse, and a logistic model weighs the
evidence. Scoring reads each text once, in one pass without a shuffle; the model has a fixed bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.names import column
from sluice.llm.common import extended, hold, slices, whole_text, worker_state
from sluice.llm.levenshtein import Lexicon, errors_for, fewer_errors

SAMPLE = 20_000  # labelled texts that the model is fitted on, at most (about)
TERMS = 5_000  # of the lexicon, the strongest
NEIGHBOURS = 50_000  # ordinary words close to a term that are remembered, the most frequent
CLEAN_SHARE = 0.1  # of a misspelling's occurrences that may lie in clean texts
CLEAN_RATIO = 4.7  # likelihood ratio beyond which a word's clean share is no chance (one in thirty)
CACHE = 300_000  # words that a worker remembers
PIECE = 1 << 20  # characters of a long text that are split at a time
APART = 8  # places between a word and the one that tells its contexts apart
WINDOW = 20  # words around a hit
QUOTE = 30  # words that a quotation spans at most
QUOTED, REPORTED = 0.25, 0.5  # what a hit counts inside a quotation, or after a word of reporting
FEATURES = 7
# Marks that open and close quotations, words that report speech.
OPENING, CLOSING = "\"“„«‹", "\"”“»›"
REPORTING = frozenset("said says wrote writes quoted called sagte schrieb nannte dit disait écrit dijo escribió llamó".split())
EDGES = "\"“”„«»‹›'’‘`.,;:!?()[]{}<>*#$%&|_~-–—…"


@dataclass(frozen=True)
class Model:
    """A fitted lexicon with weights, and the logistic model over the evidence."""

    lexicon: Lexicon
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = (evidence - np.array(self.mean)) / np.array(self.scale) @ np.array(self.coefficients) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pieces(text: str) -> Iterator[str]:
    """The text in parts that end at white space, so that no word is cut."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end


def token_facts(lexicon: Lexicon, token: str) -> tuple | None:
    """(term or -1, edits, opens a quotation, closes one, reports) of a raw token; None if it is nothing."""
    lower = token.lower()
    bare = lower if lower.isalpha() else lower.strip(EDGES)
    hit = lexicon.find(bare) if bare else None
    if bare == lower:
        if hit is None and bare not in REPORTING:
            return None
        return (hit[1] if hit else -1, hit[0] if hit else 0, False, False, bare in REPORTING)
    head, tail = token[: len(token) - len(token.lstrip(EDGES))], token[len(token.rstrip(EDGES)) :] if bare else token
    if hit is None and any(c.isalpha() for c in token):
        signed = lower.strip("\"“”„«»‹›.,;:?()[]")  # signs at the edges may stand for letters
        hit = lexicon.find(signed) if signed != bare else None
        if hit is None and signed.endswith("!"):
            hit = lexicon.find(signed.rstrip("!"))
    opens, closes, reports = any(c in OPENING for c in head), any(c in CLOSING for c in tail), bare in REPORTING
    if hit is None and not (opens or closes or reports):
        return None
    return (hit[1] if hit else -1, hit[0] if hit else 0, opens, closes, reports)


def evidence(text: str, lexicon: Lexicon, weights: tuple[float, ...], cache: dict) -> list[float]:
    """The features of a text; an empty one has only zeros."""
    events, n = [], 0
    for part in pieces(text):
        tokens = part.split()
        for at, token in enumerate(tokens, n):
            facts = cache.get(token, 0)
            if facts == 0:
                if len(cache) >= CACHE:
                    cache.clear()
                facts = cache[token] = token_facts(lexicon, token)
            if facts is not None:
                events.append((at, facts))
        n += len(tokens)
    hits = in_context(events)
    if not hits:
        return [0.0] * FEATURES
    exact = variant = quoted = 0.0
    spans: list[tuple[int, float]] = []
    for at, term, edits, share in hits:
        worth = weights[term] * share
        if edits:
            variant += worth
        else:
            exact += worth
            spans.append((at, worth))
        if share < 1:
            quoted += weights[term]
    densest, first, held = 0.0, 0, 0.0
    for at, worth in spans:
        held += worth
        while spans[first][0] < at - 2 * WINDOW:
            held -= spans[first][1]
            first += 1
        densest = max(densest, held)
    kinds = len({term for _, term, edits, _ in hits if not edits})
    dense = 100 * exact / (n + 20)
    return [math.log1p(exact), math.log1p(dense), math.log1p(variant), math.log1p(quoted), math.log1p(densest), math.log1p(kinds), math.log1p(100 * variant / (n + 20))]


def in_context(events: list[tuple[int, tuple]]) -> list[tuple[int, int, int, float]]:
    """(place, term, edits, share) of the hits; the share is below one where the words around them quote or report."""
    hits, inside, opened, reported = [], [], None, -WINDOW - 1
    for at, (term, edits, opens, closes, reports) in events:
        if opened is not None and at - opened > QUOTE:
            opened, inside = None, []
        if opens and opened is None:
            opened, inside = at, []
        if term >= 0:
            hits.append([at, term, edits, REPORTED if at - reported <= WINDOW // 2 else 1.0])
            if opened is not None:
                inside.append(len(hits) - 1)
        if closes and opened is not None and not (opens and opened == at and term < 0):
            for i in inside:
                hits[i][3] = QUOTED
            opened, inside = None, []
        if reports:
            reported = at
    return [tuple(h) for h in hits]


def word_counts(texts: DataFrame, text: str, label: str) -> DataFrame:
    """``word, toxic, clean``: how many different words stand APART places before a word, or else begin the text.

    So a passage that many texts copy counts once, and a term counts by the places it was put in, also if
    it always comes in the same phrase.
    """
    words = F.filter(F.transform(F.split(F.lower(column(text)), r"\s+"), lambda w: F.btrim(w, F.lit(EDGES))), lambda w: w != "")
    rows = texts.select(column(label).cast("long").alias("label"), words.alias("words"))
    before = F.transform(F.concat(F.array_repeat(F.get("words", F.lit(0)), APART), "words"), lambda w: F.xxhash64(w))
    rows = rows.select("label", "words", before.alias("before"))
    pairs = rows.select("label", F.explode(F.arrays_zip("words", "before")).alias("p")).select("label", F.col("p.words").alias("word"), F.col("p.before").alias("before"))
    pairs = pairs.where("word IS NOT NULL").distinct()
    return pairs.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def learn_lexicon(texts: DataFrame, text: str, label: str) -> tuple[Lexicon, tuple[float, ...]]:
    """The words that mark toxic texts, with log-odds as weights.

    A word is taken if its likelihood ratio against chance beats what the best of all words would reach
    by chance. A word close to a term is ordinary if it is significantly more often clean than a misspelling may be;
    where those left, seen too rarely to tell, are so taken together, the term allows fewer edits. At most TERMS
    terms and NEIGHBOURS ordinary words, the most frequent, are kept.
    """
    counts = hold(word_counts(texts, text, label), "toxicity-words")
    bad, good, kinds = (n or 0 for n in counts.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first())
    if not bad or not good:
        return Lexicon([]), ()
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = bad / (bad + good)
    part = lambda n, expected: F.when(n > 0, n * F.ln(n / expected)).otherwise(0.0)
    ratio = 2 * (part(t, (t + c) * share) + part(c, (t + c) * (1 - share)))
    odds = F.ln((t + 0.5) / (bad + 1)) - F.ln((c + 0.5) / (good + 1))
    marks = counts.select("word", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") > 1.5) & (F.col("ratio") > 2 * math.log(max(kinds, 2))))
    terms = sorted(marks.orderBy(F.desc("ratio"), "word").limit(TERMS).collect(), key=lambda r: r.word)
    names = [r.word for r in terms]
    near = hold(_close_words(counts, Lexicon(names)), "toxicity-near")
    usual = _clean(F.col("toxic"), F.col("clean"))
    known = near.where(usual).orderBy(F.desc("clean"), "word").limit(NEIGHBOURS).collect()
    # Both are bounded by the number of terms.
    crowds = near.where(~usual).groupBy("term", "edits").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    crowded = {r.term for r in crowds.where(_clean(F.col("toxic"), F.col("clean"))).collect() if r.edits > fewer_errors(names[r.term])}
    edits = tuple(fewer_errors(t) if i in crowded else errors_for(t) for i, t in enumerate(names))
    return Lexicon(names, frozenset(r.word for r in known), edits), tuple(min(r.odds, 4.0) for r in terms)


def _clean(toxic: Column, clean: Column) -> Column:
    """Whether a word is clean more often than CLEAN_SHARE, by the likelihood ratio; one occurrence does not tell."""
    t, c = toxic.cast("double"), clean.cast("double")
    n = t + c
    part = lambda k, share: F.when(k > 0, k * F.ln(k / (n * share))).otherwise(0.0)
    return (c > n * CLEAN_SHARE) & (2 * (part(c, CLEAN_SHARE) + part(t, 1 - CLEAN_SHARE)) > CLEAN_RATIO)


def _close_words(counts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``word, toxic, clean, term, edits`` of the words close to a term."""
    schema = "word string, toxic long, clean long, term int, edits int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.find(w) for w in batch.column(0).to_pylist()]
            close = pa.array([hit is not None and hit[0] > 0 for hit in found], pa.bool_())
            hits = [hit for hit in found if hit is not None and hit[0] > 0]
            arrays = [*batch.filter(close).columns, pa.array([t for _, t in hits], pa.int32()), pa.array([e for e, _ in hits], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "toxic", "clean", "term", "edits"])

    return counts.select("word", "toxic", "clean").mapInArrow(run, schema)


def with_evidence(docs: DataFrame, text: str, lexicon: Lexicon, weights: tuple[float, ...], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``evidence``, an array of the features."""
    rows = docs.select(*[column(c) for c in keep], whole_text(text).alias("__text"))
    schema = extended(rows.drop("__text").schema, "evidence array<double>")
    name = f"toxicity {hash((tuple(lexicon.terms), lexicon.known, lexicon.edits))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(name, dict)
        for batch in slices(batches):
            found = [evidence(t, lexicon, weights, cache) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], [*keep, "evidence"])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = SAMPLE) -> Model:
    """Fit on the texts that ``labels`` (``doc_id, toxic``) names, about ``limit`` of them, chosen by hash.

    A text labelled both ways counts as toxic. Without labels of both kinds the score is the constant 0.5.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * limit / total))
    few = known.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    texts = docs.select(column(doc_id).alias("__id"), whole_text(text).alias("__text")).join(F.broadcast(few), "__id")
    texts = hold(texts.select("__text", "__toxic"), "toxicity-sample")
    lexicon, weights = learn_lexicon(texts, "__text", "__toxic")
    rows = with_evidence(texts, "__text", lexicon, weights, ["__toxic"]).toPandas()
    x = np.array(rows["evidence"].tolist(), float).reshape(-1, FEATURES)
    y = rows["__toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, weights, (0.0,) * FEATURES, (1.0,) * FEATURES, (0.0,) * FEATURES, 0.0)
    return Model(lexicon, weights, *_logistic(x, y))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple:
    """Ridge logistic regression by Newton steps on standardised features."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - ridge @ w
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, gradient)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1])


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``score`` between 0 and 1.

    A null text is an empty one; an empty text scores as one without evidence. Very long texts are read in pieces
    that end between words. Repeated rows are each scored, alike. An empty table gives an empty one. Columns of
    ``docs`` named ``score`` are replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "score")]
    rows = docs.select(*[column(c) for c in keep], whole_text(text).alias("__text"))
    schema = extended(rows.drop("__text").schema, "score double")
    lexicon, weights = model.lexicon, model.weights
    name = f"toxicity {hash((tuple(lexicon.terms), lexicon.known, lexicon.edits))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(name, dict)
        for batch in slices(batches):
            found = [evidence(t, lexicon, weights, cache) for t in batch.column(len(keep)).to_pylist()]
            scores = model.score(np.array(found, float).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
