"""Texts that hold the string of an added token, against the library's tokenizer as its file defines it."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sluice.llm import token_counts as tc, token_files
from sluice.llm.queries import definition
from sluice.session import scratch_dir

END = "<|endoftext|>"
BITS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "　", "a", "b", "'s", "the", "é", "1", ".", " the", "漢", "<|endof", "text|>", "<", ">", END, END]), max_size=40)
TEXTS = [f"a b {END} c", END, f"in{END}side a{END}{END}b", f"x  {END}  y\n{END}\n", f"{END[:-1]} >", "no token", "", None]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_str(definition())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(definition(), added=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(BITS, max_size=4))
def test_ids(counter, plain, several):
    texts = ["".join(bits) for bits in several]
    encoder = counter.encoder
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(BITS, st.randoms(use_true_random=False))
def test_counts_after_edits(counter, plain, bits, rng):
    text, leaf, tc.LEAF = "".join(bits), tc.LEAF, 2
    try:
        tree = tc.build(text, counter)
        assert tree.n_tokens == len(plain(text))
        start = rng.randint(0, len(text))
        end = rng.randint(start, len(text))
        put = "".join(rng.choice(bits or [END]) for _ in range(rng.randint(0, 3)))
        new, tree, _ = tc.apply_edits(text, tree, [(start, end, put)], counter)
        assert new == text[:start] + put + text[end:] and tree.n_tokens == len(plain(new))
    finally:
        tc.LEAF = leaf


def test_operators(spark, plain):
    assert plain(TEXTS[0]) == [64, 275, 220, 50256, 269]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    path = scratch_dir(spark, "test-tokens")
    token_files.write_token_files(docs, definition(), path)
    want, start = {}, 0
    for i, text in enumerate(TEXTS):
        ids = np.array([*plain(text), 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, path).collect()} == want
    counted = tc.count_tokens(docs, definition())
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {i: len(plain(t)) for i, t in enumerate(TEXTS)}
    after = tc.recount(counted, definition(), lambda t: [(0, 0, END)]).collect()
    assert {r.doc_id: r.n_tokens for r in after} == {i: len(plain(END + (t or ""))) for i, t in enumerate(TEXTS)}
