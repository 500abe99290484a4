import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sluice.llm import toxicity
from sluice.llm.levenshtein import Lexicon, Trie, errors_for, nearest
from sluice.llm.queries import op2_toxicity

TERMS = ["worthless", "idiot", "scum", "pathetic", "trash", "réeuxan"]


def distance(a, b):
    """Edits between two texts: letters put in, left out, taken for another, or swapped with a neighbour."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), unique=True, min_size=1, max_size=8), st.text("abcd", max_size=9), st.integers(0, 3))
def test_automaton_agrees_with_the_distance(terms, word, errors):
    close = [(distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= errors]
    assert nearest(Trie({t: i for i, t in enumerate(terms)}), word, errors) == min(close, default=None)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(TERMS), st.data())
def test_prefilter_loses_no_misspelling(term, data):
    letters = list(term)
    for _ in range(data.draw(st.integers(0, errors_for(term)))):
        at, kind = data.draw(st.integers(0, len(letters) - 1)), data.draw(st.sampled_from("xdis"))
        letters[at : at + 1 + (kind == "s")] = {"x": ["q"], "d": [], "i": [letters[at], "q"], "s": letters[at : at + 2][::-1]}[kind]
    word = "".join(letters)
    if distance(word, term) > errors_for(term):
        return  # a letter put between swapped ones
    found = Lexicon(TERMS).find(word)
    assert found is not None and found[0] <= max(1, distance(word, term))


def test_signs_for_letters_and_ordinary_words():
    lexicon = Lexicon([*TERMS, "ass"], frozenset({"trasch", "scam"}))
    assert [lexicon.find(w) for w in ("1d10t", "idioooot", "w0rthle$$", "tra.sh", "scum", "a$$")] == [(1, 1), (1, 1), (1, 0), (1, 4), (0, 2), (1, 6)]
    assert [lexicon.find(w) for w in ("scam", "trasch", "reader", "as", "asp", "")] == [None] * 6


def test_swaps_and_short_terms():
    lexicon = Lexicon(TERMS)
    spelled = {"idoit": 1, "pahtetic": 3, "wrothless": 0, "scm": 2, "scumm": 2, "sucm": 2, "tarsh": 4, "wrohtless": 0, "apthetci": 3}
    assert {w: (lexicon.find(w) or (0, None))[1] for w in spelled} == spelled
    assert [toxicity.token_facts(Lexicon(["ass"]), w)[:2] for w in ("a$$", "a$$!", "(A$$).")] == [(0, 1)] * 3
    # Terms that ordinary words crowd around allow fewer edits.
    assert Lexicon(["scum"], edits=(0,)).find("scm") is None and Lexicon(["pathetic"], edits=(1,)).find("apthetci") is None


def shares(text):
    lexicon = Lexicon(TERMS)
    events = [(i, f) for i, t in enumerate(text.split()) if (f := toxicity.token_facts(lexicon, t)) is not None]
    return [h[3] for h in toxicity.in_context(events)]


def test_quotation_counts_less_than_abuse():
    assert shares("You are scum , an idiot.") == [1.0, 1.0]
    assert shares('They put "you are scum" on the wall, an idiot did.') == [toxicity.QUOTED, 1.0]
    assert shares('The word "idiot" is old') == [toxicity.QUOTED]
    assert shares("She said idiot once") == [toxicity.REPORTED]
    assert shares('token = "24be you scum') == [1.0]
    assert shares('"' + " word" * 40 + ' idiot"') == [1.0]


def rates(rows):
    hit = sum(r.predicted and r.toxic for r in rows)
    return hit / max(1, sum(r.toxic for r in rows)), hit / max(1, sum(r.predicted for r in rows))


def test_held_out_rows_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    found = op2_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    recall, precision = rates(found.where("held_out").join(labels, "doc_id").collect())
    assert recall > 0.85 and precision > 0.9


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"word{i % 50} {'you idiot' if i % 5 == 0 else 'good day'} other{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    return toxicity.fit(docs, labels)


def test_learned_terms_and_misspellings(spark, model):
    assert "idiot" in model.lexicon.terms and "word3" not in model.lexicon.terms
    texts = ["you idiot", "good day", "", None, "big idi0t you", "idiot " * 30_000, "x" * 3_000_000 + " idiot"]
    scores = [r.score for r in sorted(toxicity.toxicity(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), model).collect())]
    assert scores[0] > 0.5 > scores[1] == scores[2] == scores[3] and scores[5] > 0.5
    assert all(0 <= s <= 1 for s in scores)


def test_odd_rows(odd, nothing, model, spark):
    scored = toxicity.toxicity(odd, model)
    assert scored.columns == [c for c in odd.columns if c not in ("text", "score")] + ["score"]
    assert scored.count() == odd.count() and toxicity.toxicity(nothing, model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(odd, none).score(toxicity.np.zeros((1, toxicity.FEATURES))) == 0.5
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id bigint, toxic int")
    assert toxicity.fit(odd, one).lexicon.terms == []


def test_ordinary_words_by_significance(spark):
    rows = [(0, 1), (1, 0), (0, 2), (1, 2), (5, 1), (6, 3), (40, 2), (0, 50)]
    found = spark.createDataFrame(rows, "toxic int, clean int").select(toxicity._clean(F.col("toxic"), F.col("clean")).alias("usual")).collect()
    assert [r.usual for r in found] == [False, False, True, True, False, False, False, True]


def test_planted_misspellings(spark):
    """A spelling that one clean text holds still counts, an ordinary word near a term does not."""
    bad = ["you idiot there", "what scum they are", "so pathetic of them"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        told = bad[i // 3 % 3] if toxic else ["a slum in town", "some day soon"][i % 2]
        rows.append((i, " ".join([f"w{i % 53}", f"v{i % 47}", told, f"x{i % 31}", f"y{i % 29}"])))
        labels.append((i, int(toxic)))
    rows.append((900, "one quiet note about an idoit somewhere"))
    labels.append((900, 0))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {"idiot", "scum", "pathetic"} <= set(model.lexicon.terms)
    assert model.lexicon.find("slum") is None and model.lexicon.find("idoit")[0] == 1
    planted = ["idoit", "idi0t", "idiiiot", "idot", "pahtetic", "pathetc", "phatetic", "scm", "scumm"]
    assert [w for w in planted if model.lexicon.find(w) is None] == []
