"""The pipeline's stages against brute-force versions, each on its own input."""

import hashlib
import re
from collections import Counter

import sentencepiece as library
from test_jaccard import brute_force

import corpus_pipeline
from sluice.llm.queries import pieces

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given_model = library.SentencePieceProcessor(model_proto=pieces())
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.hold(stage(spark, docs, SF), "test-pipeline")
        seen[name] = (docs.collect(), out.collect())
        if name != "SentencePiece encoding":
            assert out.columns == COLUMNS
        docs = out
    before, after = seen["quality rules"]
    assert 0 < len(after) < len(before) and set(after) <= set(before)
    before, after = seen["exact dedup"]
    digest = lambda r: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text).encode()).digest()
    best = {}
    for r in sorted(before, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault(digest(r), r)
    assert Counter(after) == Counter(best.values())
    before, after = seen["SimHash near-dedup"]
    stay = set(brute_force([(r.doc_id, r.text) for r in before]))
    assert len(stay) < len(before)
    assert Counter(after) == Counter(r for r in before if r.doc_id in stay)
    before, after = seen["mixing to target weights"]
    assert set(after) <= set(before) and len(set(after)) < len(after)
    before, after = seen["SentencePiece encoding"]
    assert Counter((r.doc_id, tuple(given_model.encode(r.text))) for r in before) == Counter((r.doc_id, tuple(r.piece_ids)) for r in after)
    assert all(r.same_back for r in after)
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, after))


def test_stages_on_odd_rows(spark, odd, nothing):
    for rows in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert name == "SentencePiece encoding" or out.columns == rows.columns
            assert (out.count() > 0) == (rows is odd)
