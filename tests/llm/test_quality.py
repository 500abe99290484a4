import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.llm import quality
from sluice.llm.queries import op10_quality_rules

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if again[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def check(found, rows):
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert found == Counter((i, *plain(t)) for i, t in rows)


def test_query_against_brute_force(spark, table):
    found = op10_quality_rules(spark, SF).collect()
    check(found, [(r.doc_id, r.text) for r in table("documents").collect()])
    assert not any(r.kept for r in found if r.base_failed)


def test_odd_rows(odd, table):
    judged = quality.judge(odd, table("labels"))
    check(judged.collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert "text" not in judged.columns and "lang" in judged.columns


def test_repeats_by_hand(spark):
    a = "one two three four five"
    cases = [a, f"{a} {a}", f"{a} six {a}", "x " * 5, "x " * 6, f"{a} {a} {a}\n{a}\n{a}\n\n\n \n \n", "a\nb\na\n a\na", "# a|b <c> $1 %2 &3 *4"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    stats = quality.with_stats(docs).withColumn("base_failed", quality.base_failed())
    check(stats.collect(), list(enumerate(cases)))


def test_empty_tables(spark, nothing, table):
    labels = table("labels")
    assert quality.judge(nothing, labels).count() == 0
    assert quality.well_written(nothing, labels).count() == 0
    unlabelled = spark.createDataFrame([], labels.schema)
    assert all(r.kept != r.base_failed for r in quality.judge(table("documents"), unlabelled).select("kept", "base_failed").collect())


def test_rows_that_stay_keep_their_columns(odd, table):
    stay = quality.well_written(odd, table("labels"))
    assert stay.columns == odd.columns
    assert {r.doc_id for r in stay.collect()} <= {r.doc_id for r in odd.collect() if not plain(r.text)[-1]}


def test_learned_list_separates_the_labels(spark):
    """Labels of a larger table: most rejected ones are found, hardly a clean one is lost."""
    sf = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    found = Counter((r.quality, r.kept) for r in judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "kept").collect())
    assert found[0, False] / (found[0, False] + found[0, True]) > 0.8
    assert found[1, False] / (found[1, False] + found[1, True]) < 0.02


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(0 if x > 7 and y <= 3 else 1, x, y) for x in range(10) for y in range(10) for _ in range(6)]
    frame = spark.createDataFrame([(a, float(b), float(c), float(n * 7919 % 601)) for n, (a, b, c) in enumerate(rows)], "label int, symbols double, capitals double, digits double")
    return frame.select("label", *[F.col(f) if f in ("symbols", "capitals", "digits") else F.lit(0.0).alias(f) for f in quality.FEATURES])


def test_rules_are_conjunctions_of_thresholds(grid):
    rules = quality.learn_rules(grid)
    assert len(rules.rules) == 1
    assert {(c.feature, c.above, c.threshold) for c in rules.rules[0]} == {("symbols", True, 7.5), ("capitals", False, 3.5)}
    wrong = grid.where(rules.keeps() != (grid["label"] == 1)).count()
    assert wrong == 0 and "THEN reject" in str(rules)


def test_noise_gives_no_rule(spark):
    noise = spark.range(400).select((F.pmod(F.xxhash64("id"), F.lit(2))).alias("label"), *[(F.pmod(F.xxhash64(F.lit(f), "id"), F.lit(97)) / 97.0).alias(f) for f in quality.FEATURES])
    assert quality.learn_rules(noise).rules == ()


def test_main_path_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality.with_stats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
