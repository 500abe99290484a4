"""How filters interact: contingency tensors of their verdicts, contracted for every order and step.

Every document fails or passes each filter; Spark counts the documents of each part by pattern of failures, which
leaves at most 32 rows a part whatever its size. A part's counts form a tensor with one axis of length two (pass,
fail) for each filter. A step of an order selects on every axis pass, fail or all, so the counts of all orders and
steps are one ``einsum`` of the tensor with those selectors. No order is ever run over the documents.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.common import WORD_BREAK, hold, settled, whole_text

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n", "n_good", "n_toxic")
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)  # of each axis: what is selected
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _words(text: Column) -> tuple[Column, Column]:
    """Numbers of words and of different words: pieces between white space, but for empty ones at either end."""
    pieces = F.split(text, f"{WORD_BREAK}+")
    first, last = (F.element_at(pieces, 1) == "").cast("int"), (F.element_at(pieces, -1) == "").cast("int")
    alone = F.size(pieces) == 1
    empty = F.when(alone, first).otherwise(first + last)
    return F.size(pieces) - empty, F.size(F.array_distinct(pieces)) - F.greatest(first, last)


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text only."""
    n_words, n_distinct = _words(text)
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": n_words < 100,
        "B": n_distinct.cast("long") * 100 < n_words.cast("long") * 80,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """``(doc_id, part, A, B, C, D, E)`` for each row: its part and whether it fails each filter.

    A text repeats if any smaller id has the same one: a group of copies is reduced to its smallest id in each task
    first, and rows find it again by text and id, so no task gets a whole group. Rows without an id come after all
    others and are alike among themselves.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole_text(text).alias("__text"))
    verdicts = [c.alias(name) for name, c in text_failures(F.col("__text")).items()]
    marked = hold(settled(rows.select("doc_id", "part", F.unhex(F.sha2("__text", 256)).alias("digest"), *verdicts)), "audit-verdicts")
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    mine = (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    found = marked.join(first, mine, "left")
    return found.select("doc_id", "part", *"ABCD", F.col("first_digest").isNull().alias("E"))


def patterns(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, A..E, n, n_good, n_toxic)``: documents by part and pattern of failures."""
    # Repeated labels of a document count once.
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = judged.join(known, F.col("doc_id") == F.col("label_id"), "left")
    counts = F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("n_good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("n_toxic")
    return labelled.groupBy("part", *FILTERS).agg(*counts)


def steps() -> list[tuple[str, int]]:
    return [("".join(order), k) for order in permutations(FILTERS) for k in range(1, len(order) + 1)]


def selectors(order: str, step: int) -> dict[str, list[tuple[int, int]]]:
    """What each count of a step selects on each axis."""
    earlier, here = order[: step - 1], order[step - 1]
    axes = lambda before, own, after: [own if f == here else before if f in earlier else after for f in FILTERS]
    return {"kept": axes(PASS, PASS, ALL), "removed": axes(PASS, FAIL, ALL), "fails": axes(ALL, FAIL, ALL), "unique_fails": axes(PASS, FAIL, PASS)}


def contracted(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """Each count for all orders and steps, by measure: ``tensor`` has an axis of measures, then one for each filter."""
    chosen = [selectors(*s) for s in steps()]
    out = {}
    for name in chosen[0]:
        sides = np.array([c[name] for c in chosen], np.int64)  # step, axis, pass or fail
        out[name] = np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensor, *sides.transpose(1, 0, 2), optimize=True)
    return out


def step_counts(counts: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of a part."""
    tensor = np.zeros((len(MEASURES), *[2] * len(FILTERS)), np.int64)
    for row in counts.itertuples(index=False):
        tensor[(slice(None), *(int(getattr(row, f)) for f in FILTERS))] += [getattr(row, m) for m in MEASURES]
    found = contracted(tensor)
    out = pd.DataFrame(steps(), columns=["filter_order", "step"])
    out.insert(0, "part", counts["part"].iloc[0])
    (out["removed"], out["good_lost"], out["toxic_lost"]), out["kept"] = found["removed"], found["kept"][0]
    out["redundant"], out["unique_fails"] = found["fails"][0] - found["removed"][0], found["unique_fails"][0]
    here = [order[k - 1] for order, k in steps()]
    out["shapley"] = out.groupby(here)["removed"].transform("sum")
    return out[[c.split()[0] for c in RESULT.split(", ")]]


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step; see ``RESULT``.

    Failures: A, fewer than 100 words; B, different words are less than 80 % of all; C, more than 10 % of the code points
    are capitals A-Z; D, one of ``#$%&*|``; E, a row with a smaller id has the same text, in any part, whether
    removed or not. A null text is an empty one, a null part the empty string. ``labels`` marks documents by ``quality``
    and ``toxic``; several rows for one id count once, missing ones as neither. Rows that repeat an id are counted one by
    one; texts of any length are read whole; other columns play no part. An empty table has no parts.
    """
    return patterns(judge(docs, text, doc_id, part), labels).groupBy("part").applyInPandas(step_counts, RESULT)
