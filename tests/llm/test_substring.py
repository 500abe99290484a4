"""Repeated passages against a brute-force version that compares whole windows of words."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sluice.llm import substring
from sluice.llm.queries import op11_substring_dedup

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_force(rows, size=13):
    """(doc_id, n_words, spans, kept text) of each row."""
    first = {}
    for doc_id, text in rows:
        words = words_of(text)
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if doc_id is not None and first[tuple(words[i : i + size])] < doc_id:
                gone[i : i + size] = [True] * size
        spans = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        out.append((doc_id, len(words), tuple(spans), " ".join(w for w, g in zip(words, gone) if not g)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_words, tuple((s.first, s.end) for s in r.spans), r.kept_text) for r in df.collect())


def test_query_against_brute_force(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    want = Counter((i, n, sum(e - f for f, e in spans), hashlib.sha256(kept.encode()).hexdigest()) for i, n, spans, kept in brute_force(rows).elements())
    got = op11_substring_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert sum(n > 0 for _, _, n, _ in want) > 5


def test_odd_rows(odd, nothing):
    assert found(substring.remove_repeats(odd)) == brute_force([(r.doc_id, r.text) for r in odd.collect()])
    assert substring.remove_repeats(nothing).count() == 0


def test_shared_passages_in_small_slices(spark, monkeypatch):
    """Passages in a third of all rows, copies, windows that touch, negative ids; many slices, buckets and groups."""
    monkeypatch.setattr(substring, "SLICE", 300)
    monkeypatch.setattr(substring, "BUCKET", 200)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    passage, other = [word() for _ in range(40)], [word() for _ in range(13)]
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.choice([0, 1, 12, 13, 14, 60]))]
        if i % 3 == 0:
            words += passage[rng.randrange(20) :] + words[:5]
        if i % 5 == 0:
            words += other + passage + other + [word()]
        rows.append((rng.choice([None, i, i, i, -i, 7 * 2**40 + i, -(2**63), 2**63 - 1]), " \n".join(words)))
    rows += [(9000 + i, rows[30][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_force(rows)
    assert sum(len(spans) > 1 for _, _, spans, _ in want) > 10
    assert found(substring.remove_repeats(docs)) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 14))
def test_hashes_are_equal_where_windows_are(values, size):
    words = [str(v).encode() for v in values]
    hashes = substring.Roller(size).hashes(substring.word_hashes(words)).tolist()
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    assert len(hashes) == len(windows)
    assert len(set(zip(hashes, windows))) == len(set(hashes)) == len(set(windows))


@pytest.mark.parametrize("numbers", [[], [0], [1, 2, 2**63 - 1, -1, -(2**63)]])
def test_packed_numbers_come_back(numbers):
    numbers = np.array(numbers, np.int64)
    assert substring.unpack(substring.pack(numbers), np.int64).tolist() == numbers.tolist()


def test_intervals_merge_where_they_touch():
    assert substring.intervals(np.array([], int), 3) == []
    assert substring.intervals(np.array([0, 1, 4, 8]), 3) == [(0, 7), (8, 11)]
