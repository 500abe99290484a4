import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sluice.llm import lm
from sluice.llm.eliasfano import EliasFano, Trie
from sluice.llm.queries import op9_lm_scoring

SF = "/root/testdata/sf0.001"
WORDS = st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.lists(st.integers(0, 300), max_size=80)), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_sequences(values, queries):
    values = sorted(values)
    held = EliasFano.build(np.array(values, np.uint64))
    if values:
        assert held.at(np.arange(len(values))).tolist() == values
    asked = np.array(queries + values + [v + 1 for v in values if v < 2**64 - 1] + [0], np.uint64)
    assert held.successors(asked).tolist() == [sum(v < q for v in values) for q in asked.tolist()]
    assert (held.find(asked) >= 0).tolist() == [q in values for q in asked.tolist()]


def test_trie_from_files(tmp_path):
    rng = np.random.default_rng(1)
    contexts, words = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)), np.unique(rng.integers(0, 2**40, 200).astype(np.uint64))
    pairs = np.unique(rng.integers(0, len(contexts) * len(words), 5000))
    of, successors = pairs // len(words), pairs % len(words)
    codes = rng.integers(1, 60_000, len(pairs)).astype(np.uint16)
    Trie.build(contexts, words, of, successors, codes, np.arange(len(contexts), dtype=np.float32)).save(str(tmp_path))
    trie = Trie.load(str(tmp_path))
    want = {(int(contexts[a]), int(words[b])): int(c) for a, b, c in zip(of, successors, codes)}
    asked = [(int(c), int(w)) for c in contexts[:100] for w in words] + [(5, int(words[0])), (int(contexts[0]), 5)]
    place = trie.context(np.array([c for c, _ in asked], np.uint64))
    assert trie.lookup(place, np.array([w for _, w in asked], np.uint64)).tolist() == [want.get(q, 0) for q in asked]
    assert isinstance(trie.successors.low, np.memmap) and trie.weights[trie.context(contexts[7:8])][0] == 7


def tokens(text):
    lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\0end"]


def expected(rows, learn, discount=lm.DISCOUNT):
    train = [tokens(t) for i, t in rows if learn(i)]
    counts = Counter(w for t in train for w in t)
    total = sum(counts.values())
    pairs = Counter(p for t in train for p in zip(["\0begin", *t], t))
    follows, kinds = Counter(), Counter()
    for (a, _), n in pairs.items():
        follows[a] += n
        kinds[a] += 1
    unigram = lambda w: (counts[w] + 1) / (total + len(counts) + 1)

    def p(a, w):
        if not follows[a]:
            return unigram(w)
        seen = max(0.0, pairs[a, w] - discount) / follows[a]
        return seen + discount * kinds[a] / follows[a] * unigram(w)

    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10(unigram(w)) for w in own)
        score = sum(math.log10(p(a, w)) for a, w in zip(["\0begin", *own], own))
        out.append((i, len(own), sum(counts[w] > 0 for w in own), total, base, score))
    return out


def check(found, want):
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    for f, w in zip(found, want):
        assert f[4] == pytest.approx(w[4], rel=1e-9) and f[5] == pytest.approx(w[5], rel=1e-3, abs=1e-3 * w[1])


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_query_against_brute_force(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    found = op9_lm_scoring(spark, SF).collect()
    check(found, expected(rows, lambda i: not held_out(i)))
    assert all(r.held_out == held_out(r.doc_id) for r in found)


def test_many_groups_and_shards(spark, odd, monkeypatch):
    """The same with small groups, many shards and few hot contexts."""
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 9000 else r.text[:9000]) for r in odd.collect()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    learn = F.col("doc_id").isNull() | (F.col("doc_id") != 7)
    want = expected(rows, lambda i: i != 7)
    check(lm.lm_scores(frame, learn).collect(), want)
    monkeypatch.setattr(lm, "GROUP_TOKENS", 700)
    monkeypatch.setattr(lm, "SHARD_ENTRIES", 60)
    monkeypatch.setattr(lm, "HOT_SHARE", 40)
    # One discount for all shards: scores do not depend on how many there are.
    check(lm.lm_scores(frame, learn).collect(), want)
    check(lm.lm_scores(frame, learn, discount=0.3).collect(), expected(rows, lambda i: i != 7, 0.3))
    with pytest.raises(ValueError):
        lm.lm_scores(frame, learn, discount=1.0)


def test_probabilities_sum_to_one(spark):
    """Over the words that training knows and one unknown word, after a context."""
    texts = ["a b a c", "a b b", "c a b a", "b"]
    probes = ["x a", "x a a", "x a b", "x a c", "x a zz"]
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(probes))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in lm.lm_scores(frame, F.col("doc_id") < 100).collect()}
    # P(w | a) from texts with and without w: ends after w are taken off by the brute-force version.
    check_rows = expected(rows, lambda i: i < 100)
    assert all(scores[r[0]] == pytest.approx(r[5], abs=5e-3) for r in check_rows)
    after_a = {"end": scores[100]}
    assert after_a["end"] < 0 and scores[104] == min(scores[i] for i in range(101, 105))


def test_held_out_texts_beat_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r for r in op9_lm_scoring(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_tables(spark, nothing):
    assert lm.lm_scores(nothing, F.lit(True)).count() == 0
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    check(lm.lm_scores(frame, F.lit(False)).collect(), expected([(1, "a b"), (2, None)], lambda i: False))
