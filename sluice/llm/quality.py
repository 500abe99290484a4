"""Quality rules: statistics of whole texts and a learned decision list, all as Spark expressions.

A text is split once; windows of five words become 64-bit hashes inside the row, so repeats are found
by sorting a row's own hashes and nothing is shuffled. The decision list is learned by sequential
covering: a rule grows by the threshold that gains most, is pruned on other rows, and the rows
it covers are set aside. Growing needs only counts by feature and threshold, one aggregate a step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.names import column
from sluice.llm.common import WORD_BREAK, hold, settled, whole_text

WINDOW = 5  # words
SYMBOLS = r"[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "exclamations", "digits", "bars", "line_words", "variety")
SAMPLE = 100_000  # labelled rows that the list is learned from, at most (about)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text column, with the base statistics and the features.

    A null text has no words; a text without words has all statistics zero. Whole texts count,
    whatever their length, and each row is looked at by itself.
    """
    own = [c for c in docs.columns if c not in (text, *BASE, *FEATURES)]
    keep = [column(c) for c in own]
    rows = docs.select(*keep, whole_text(text).alias("__text"))
    edges = " \t\n\x0b\x0c\r"
    rows = rows.select(*keep, "__text", F.btrim("__text", F.lit(edges)).alias("__bare"))
    words = F.when(F.col("__bare") != "", F.split("__bare", f"{WORD_BREAK}+")).otherwise(F.array().cast("array<string>"))
    rows = rows.select(*keep, "__text", words.alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *keep,
        F.size("__words").alias("__n"),
        F.char_length(F.array_join("__words", "")).alias("__chars"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        lines.alias("__lines"),
        *[F.regexp_count("__text", F.lit(p)).alias(n) for n, p in (("__symbols", SYMBOLS), ("__exclaim", "!"), ("__digits", "[0-9]"))],
        F.char_length(F.regexp_replace("__text", "[^A-Z]+", "")).alias("__capitals"),
        F.regexp_count("__text", F.lit(r"\|")).alias("__bars"),
    )
    counted = ["__n", "__chars", "__symbols", "__exclaim", "__digits", "__capitals", "__bars"]
    window = F.transform(F.sequence(F.lit(0), F.col("__n") - WINDOW), lambda i: F.xxhash64(*[F.get("__hashes", i + j) for j in range(WINDOW)]))
    rows = rows.select(
        *keep,
        *counted,
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("__dup_lines"),
        F.size(F.array_distinct("__hashes")).alias("__kinds"),
        F.when(F.col("__n") > WINDOW, window).alias("__windows"),
    )
    counted += ["__n_lines", "__dup_lines", "__kinds"]
    # Only texts with a repeated window pay for sorting.
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    sorted_windows = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*keep, *counted, F.when(repeated, sorted_windows).alias("__sorted"))

    def met_again(w: Column, j: Column) -> Column:
        same = lambda k: F.coalesce(F.get("__sorted", k).h == w.h, F.lit(False))
        return same(j - 1) | same(j + 1)

    places = F.sort_array(F.transform(F.filter("__sorted", met_again), lambda w: w.i))
    rows = rows.select(*keep, *counted, places.alias("__places"))
    # Each place covers WINDOW words, or those up to the next place.
    reach = F.transform("__places", lambda p, j: F.least(F.coalesce(F.get("__places", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0))
    rows = rows.select(*keep, *counted, covered.alias("__repeats"))
    n, chars = F.greatest("__n", F.lit(1)).cast("double"), F.greatest("__chars", F.lit(1)).cast("double")
    n_lines = F.greatest("__n_lines", F.lit(1)).cast("double")
    base = dict(zip(BASE, ("__n", "__chars", "__symbols", "__dup_lines", "__repeats")))
    features = {
        "words": F.col("__n").cast("double"),
        "word_length": F.col("__chars") / n,
        "symbols": F.col("__symbols") / chars,
        "dup_lines": F.col("__dup_lines") / n_lines,
        "repeats": F.col("__repeats") / n,
        "capitals": F.col("__capitals") / chars,
        "exclamations": F.col("__exclaim") / n,
        "digits": F.col("__digits") / chars,
        "bars": F.col("__bars") / n,
        "line_words": n / n_lines,
        "variety": F.col("__kinds") / n,
    }
    return settled(rows.select(*keep, *[F.col(c).cast("long").alias(name) for name, c in base.items()], *[features[f].alias(f) for f in FEATURES]))


def base_failed() -> Column:
    """The fixed rules: fewer than ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction that rejects; a row that no rule covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        """The list as one conditional expression over the features."""
        verdict = F.lit(True)
        for rule in reversed(self.rules):
            verdict = F.when(_all(rule), F.lit(False)).otherwise(verdict)
        return verdict

    def __str__(self) -> str:
        lines = [" AND ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in self.rules]
        return "\n".join(f"IF {line} THEN reject" for line in lines) + "\nELSE keep"


def _all(rule: tuple[Condition, ...] | list[Condition]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def learn_rules(
    labelled: DataFrame,
    label: str = "label",
    max_rules: int = 12,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_covered: int = 3,
    cuts: int = 32,
) -> DecisionList:
    """Rules for label 0 (reject) against 1 (keep), from rows with the features.

    Two thirds of the rows, chosen by a hash of their features, grow rules and the rest prunes them.
    A rule must reject at least ``min_covered`` rows, with ``min_precision`` on both parts; the
    search ends at the first that does not. Rows with other labels are ignored. Without
    rows of both labels the list is empty and keeps everything.
    """
    rows = labelled.where(column(label).isin(0, 1)).select(column(label).cast("int").alias("label"), *FEATURES)
    part = F.when(F.pmod(F.xxhash64(*FEATURES), F.lit(3)) == 0, F.lit("prune")).otherwise(F.lit("grow"))
    rows = hold(rows.withColumn("part", part), "quality-rows")
    shares = [i / cuts for i in range(cuts + 1)]
    found = rows.groupBy("label").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).collect()
    if {r.label for r in found} != {0, 1}:
        return DecisionList(())
    # A threshold lies halfway between neighbours, so that rows at a quantile do not decide it.
    thresholds = {f: _between(sorted({v for r in found for v in r[f]})) for f in FEATURES}
    thresholds = {f: cuts for f, cuts in thresholds.items() if cuts}
    rules: list[tuple[Condition, ...]] = []
    left = rows
    while len(rules) < max_rules:
        rule = _grow(left.where("part = 'grow'"), thresholds, max_conditions, min_precision)
        rule = _prune(left.where("part = 'prune'"), rule)
        if not rule:
            break
        counts = _counts(left, [_all(rule) & (F.col("part") == p) & (F.col("label") == y) for p in ("grow", "prune") for y in (0, 1)])
        grown, pruned = _precision(counts[0], counts[1]), _precision(counts[2], counts[3])
        if counts[0] + counts[2] < min_covered or grown < min_precision or (counts[2] + counts[3] > 0 and pruned < min_precision):
            break
        rules.append(tuple(rule))
        left = left.where(~_all(rule))
    return DecisionList(tuple(rules))


def _between(values: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _precision(bad: int, good: int) -> float:
    return bad / (bad + good) if bad + good else 0.0


def _counts(rows: DataFrame, tests: list[Column]) -> list[int]:
    return [n or 0 for n in rows.agg(*[F.sum(t.cast("int")) for t in tests]).first()]


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], max_conditions: int, min_precision: float) -> list[Condition]:
    """Add the condition of most information gain until the rule is clean enough."""
    places = [F.struct(F.lit(f).alias("f"), _place(f, cuts).alias("place")) for f, cuts in thresholds.items()]
    if not places:
        return []
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        placed = rows.where(_all(rule)).select("label", F.explode(F.array(*places)).alias("at"))
        table = placed.groupBy("at.f", "at.place").agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good")).collect()
        counts = {f: [[0, 0] for _ in range(len(cuts) + 1)] for f, cuts in thresholds.items()}
        for r in table:
            counts[r.f][r.place] = [r.bad, r.good]
        bad, good = (sum(c[i] for c in next(iter(counts.values()))) if table else 0 for i in (0, 1))
        if not bad or not good or (rule and _precision(bad, good) >= max(min_precision, 0.99)):
            break
        best, gain = None, 0.0
        for f, cuts in thresholds.items():
            below = [0, 0]
            for at, cut in enumerate(cuts):
                below = [below[0] + counts[f][at][0], below[1] + counts[f][at][1]]
                for above, (p, n) in ((False, below), (True, [bad - below[0], good - below[1]])):
                    if p:
                        won = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                        if won > gain + 1e-9:
                            best, gain = Condition(f, above, cut), won
        if best is None:
            break
        rule.append(best)
    return rule


def _place(feature: str, cuts: list[float]) -> Column:
    """How many thresholds lie below a row's value."""
    value = F.col(feature)
    return F.size(F.filter(F.lit(cuts), lambda cut: cut < value))


def _prune(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The shortest beginning of the rule that does best on rows it was not grown on."""
    if not rule:
        return rule
    tests = [_all(rule[:k]) & (F.col("label") == y) for k in range(1, len(rule) + 1) for y in (0, 1)]
    counts = _counts(rows, tests)
    worth = [(counts[2 * k] - counts[2 * k + 1]) / max(1, counts[2 * k] + counts[2 * k + 1]) for k in range(len(rule))]
    if max(worth) <= 0:
        return rule
    return rule[: worth.index(max(worth)) + 1]


def bounded_sample(labels: DataFrame, limit: int = SAMPLE, doc_id: str = "doc_id") -> DataFrame:
    """The labelled rows whose hashed id lies below a share that leaves about ``limit`` of them."""
    total = labels.count()
    if total <= limit:
        return labels
    return labels.where(F.pmod(F.xxhash64(column(doc_id)), F.lit(1 << 30)) < int((1 << 30) * limit / total))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = SAMPLE, **learning) -> DataFrame:
    """``docs`` without its text, with the statistics, ``base_failed`` and ``kept``.

    ``labels`` has ``doc_id, quality``. The list is learned on a sample of about ``limit`` labelled
    rows that pass the fixed rules. ``kept`` is false where a fixed rule fails, else the list's verdict.
    """
    stats = hold(with_stats(docs, text), "quality-stats")
    names = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    names = bounded_sample(names.select("doc_id", "quality").distinct(), limit).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label"))
    known = stats.where(~base_failed()).join(names, column(doc_id) == F.col("__id")).select(F.col("__label"), *FEATURES)
    rules = learn_rules(known, "__label", **learning)
    out = stats.withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.keeps()))


def well_written(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = SAMPLE, **learning) -> DataFrame:
    """The rows of ``docs`` that the fixed rules and the learned list keep, with all their columns.

    Only the sampled labelled rows, ``limit`` or so, are read twice: their ids are broadcast.
    """
    row = F.struct(*[column(c) for c in docs.columns]).alias("__row")
    stated = with_stats(docs.select(row, column(doc_id).alias("__id"), column(text).cast("string").alias("text")), "text")
    names = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    names = bounded_sample(names.select("doc_id", "quality").distinct(), limit).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label"))
    few = docs.select(column(doc_id).alias("__id"), column(text).cast("string").alias("text")).join(F.broadcast(names), "__id")
    rules = learn_rules(with_stats(few, "text").where(~base_failed()).select("__label", *FEATURES), "__label", **learning)
    return stated.where(~base_failed() & rules.keeps()).select("__row.*")
