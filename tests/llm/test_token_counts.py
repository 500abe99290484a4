import random

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sluice.llm import token_counts as tc
from sluice.llm.bpe import Encoder
from sluice.llm.queries import definition, op3_token_counts, redactions

SF = "/root/testdata/sf0.001"
BITS = st.lists(st.sampled_from([" ", "\n", "\t", "　", "\x85", "\x1c", "a", "b", "'s", "'r", "e", "'", "the", "é", "1", ".", " the", "ing", "  ", "漢", "🙂", "<|endoftext|>"]), max_size=40)


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_str(definition())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(definition())


def edited(text, edits):
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    return text


@settings(max_examples=300, deadline=None)
@given(BITS)
def test_parts_give_the_ids_of_the_whole(counter, plain, bits):
    import numpy as np

    text = "".join(bits)
    encoder: Encoder = counter.encoder
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == plain(text)


@settings(max_examples=300, deadline=None)
@given(BITS, st.randoms(use_true_random=False))
def test_counts_after_edits(counter, plain, bits, rng):
    text, leaf, tc.LEAF = "".join(bits), tc.LEAF, 2
    try:
        tree = tc.build(text, counter)
        assert (tree.n_tokens, tree.n_chars) == (len(plain(text)), len(text))
        places = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(0, 3)))
        edits = [(a, b, "".join(rng.choice(bits or [" "]) for _ in range(rng.randint(0, 3)))) for a, b in zip(places[::2], places[1::2])]
        edits = [e for e, f in zip(edits, edits[1:] + [(len(text) + 1,)]) if e[1] < f[0] or e[0] < e[1] <= f[0]]
        new, tree, _ = tc.apply_edits(text, tree, edits, counter)
        assert new == edited(text, edits)
        assert (tree.n_tokens, tree.n_chars) == (len(plain(new)), len(new))
        rebuilt = tc.SegmentTree(*tree.leaf_sums())
        assert (rebuilt.chars, rebuilt.tokens) == (tree.chars, tree.tokens)
    finally:
        tc.LEAF = leaf


def test_only_the_surroundings_are_encoded_again(counter, plain):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20_000))
    tree = tc.build(text, counter)
    new, tree, again = tc.apply_edits(text, tree, [(70_000, 70_004, "X Y"), (10, 12, "")], counter)
    assert tree.n_tokens == len(plain(new)) and again < 2_000
    assert tree.tokens_before(100) == len(plain(new[: tree.leaf_sums()[0][0] and sum(tree.leaf_sums()[0][:100])]))


@settings(max_examples=100, deadline=None)
@given(st.randoms(use_true_random=False))
def test_many_edits_in_one_sweep(counter, plain, rng):
    """Edits near and far from each other, insertions at one place, whole deletions, and edits of an edited tree."""
    text, leaf, tc.LEAF = "".join(rng.choice([" ab", "\n", "c", "  ", " the", ".", "'s"]) for _ in range(rng.randint(0, 300))), tc.LEAF, rng.choice([1, 3])
    try:
        tree = tc.build(text, counter)
        for _ in range(3):
            places = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(0, 12)))
            edits = [(a, b, rng.choice(["", " ", "x", " y z", "\n\n", "word" * 5])) for a, b in zip(places[::2], places[1::2])]
            edits += [(places[0], places[0], "q")] * 2 if places else []
            edits = [(0, len(text), "")] if rng.random() < 0.1 else edits
            rng.shuffle(edits)
            new, tree, again = tc.apply_edits(text, tree, edits, counter)
            assert new == edited(text, edits) and again <= len(new)
            assert (tree.n_tokens, tree.n_chars) == (len(plain(new)), len(new))
            rebuilt = tc.SegmentTree(*tree.leaf_sums())
            assert (rebuilt.chars, rebuilt.tokens) == (tree.chars, tree.tokens)
            text = new
    finally:
        tc.LEAF = leaf


def test_edits_cost_linear_work(counter):
    """No character is encoded twice, and ten times the edits take far less than a hundred times as long."""
    import time

    text = "some words here and there " * 40_000
    spent = {}
    for n in (2_000, 20_000):
        step, tree = len(text) // n, tc.build(text, counter)
        started = time.process_time()
        new, tree, again = tc.apply_edits(text, tree, [(i * step, i * step + 2, "xyz w") for i in range(n)], counter)
        spent[n] = time.process_time() - started
        assert tree.n_chars == len(new) and again <= len(new)
    assert spent[20_000] < 30 * spent[2_000], spent


def test_wrong_edits_are_refused(counter):
    tree = tc.build("some words", counter)
    for edits in ([(0, 3, ""), (2, 4, "")], [(5, 99, "")], [(-1, 2, "")], [(4, 2, "")]):
        with pytest.raises(ValueError):
            tc.apply_edits("some words", tree, edits, counter)


def test_query_against_brute_force(spark, table, plain):
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    found = op3_token_counts(spark, SF).collect()
    assert len(found) == len(texts) and sum(r.n_edits for r in found) > 0
    for r in found:
        edits = redactions(texts[r.doc_id])
        assert (r.n_tokens_before, r.n_edits) == (len(plain(texts[r.doc_id])), len(edits))
        assert r.n_tokens_after == len(plain(edited(texts[r.doc_id], edits)))


def test_odd_rows(spark, odd, nothing, plain):
    counted = tc.count_tokens(odd, definition())
    rows = counted.collect()
    assert all(r.n_tokens == len(plain(r.text)) for r in rows) and {r.score for r in rows} == {"own"}
    edits = spark.createDataFrame([(10, 0, 4, "new"), (10, 0, 4, "new"), (9, 0, 0, "a "), (None, 0, 1, "x"), (99, 0, 0, "x")], "doc_id bigint, start int, end int, text string")
    after = tc.recount(tc.with_edits(counted, edits), definition(), "edits").collect()
    assert len(after) == len(rows)
    assert all(r.n_tokens == len(plain(r.text)) and r.n_edits == (1 if r.doc_id in (9, 10) else 0) for r in after)
    assert tc.count_tokens(nothing, definition()).count() == 0
    assert tc.recount(tc.count_tokens(nothing, definition()), definition(), redactions).count() == 0
