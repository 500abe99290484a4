import numpy as np
import pytest
import sentencepiece as library
from hypothesis import given, settings, strategies as st

from sluice.llm import sentencepiece as sp
from sluice.llm.queries import op5_sentencepiece, pieces

SF = "/root/testdata/sf0.001"
BITS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "b", "'s", "é", "d", "1", ".", "<s>", "▁", "the", "er", " in", "漢", "字", "🙂", "ﬁ", "0x", "ing", "　"]), max_size=24)


@pytest.fixture(scope="module")
def given_model():
    return library.SentencePieceProcessor(model_proto=pieces())


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(pieces())


@settings(max_examples=500, deadline=None)
@given(BITS)
def test_ids_are_those_of_the_library(codec, given_model, bits):
    text = "".join(bits)
    ids = codec.encode([text])[0]
    assert ids.tolist() == given_model.encode(text)
    assert codec.decode(ids) == given_model.decode(ids.tolist()) == text.replace("▁", " ")


def test_query_against_the_library(spark, table, given_model):
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    found = op5_sentencepiece(spark, SF).collect()
    assert len(found) == len(texts)
    assert all(r.piece_ids == given_model.encode(texts[r.doc_id]) and r.n_pieces == len(r.piece_ids) and r.same_back for r in found)


def unigram(scores):
    """A codec over made-up pieces with sums of scores, without a file."""
    codec = sp.Codec(pieces())
    codec.pieces = {p: i for i, p in enumerate(scores)}
    codec.scores = list(scores.values())
    codec.strings = {i: p for p, i in codec.pieces.items()}
    codec.merges, codec.least, codec.letters = False, min(codec.scores), {}
    codec.automaton = sp.ahocorasick.Automaton()
    for p, i in codec.pieces.items():
        codec.automaton.add_word(p, (len(p), i))
    codec.automaton.make_automaton()
    return codec


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=4), st.integers(-20, -1).map(float), min_size=1, max_size=8), st.text("abc", min_size=1, max_size=9))
def test_viterbi_finds_the_best_sum(scores, text):
    codec = unigram(scores)

    def best(rest):
        if not rest:
            return 0.0
        ways = [scores[p] + best(rest[len(p) :]) for p in scores if rest.startswith(p)]
        return max([*ways, codec.least - 10 + best(rest[1:])])

    path = codec.best_path(text)
    assert "".join(codec.strings[i] for i in path) == text
    assert sum(codec.scores[i] if i < len(codec.scores) else codec.least - 10 for i in path) == best(text)


def test_odd_rows(odd, nothing, given_model):
    encoded = sp.encode(odd, pieces(), verify=True)
    assert encoded.columns == [c for c in odd.columns if c not in ("text", "piece_ids")] + ["piece_ids", "same_back"]
    want = sorted((str(r.doc_id), given_model.encode(r.text or "")) for r in odd.collect())
    assert sorted((str(r.doc_id), r.piece_ids) for r in encoded.collect()) == want
    back = sp.decode(encoded.drop("same_back"), pieces()).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in odd.collect())
    assert sp.encode(nothing, pieces()).count() == 0 and sp.decode(sp.encode(nothing, pieces()), pieces()).count() == 0


def test_null_and_broken_ids(spark, codec):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [3 + 0xFF])], "doc_id bigint, piece_ids array<int>")
    assert {r.doc_id: r.text for r in sp.decode(frame, pieces()).collect()} == {1: None, 2: "", 3: "�"}
    assert codec.decode(np.array([], np.int64)) == ""
