import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sluice.llm import rangecoder, token_files
from sluice.llm.queries import definition, op8_token_files
from sluice.session import scratch_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_str(definition())
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows, plain):
    out, start = {}, 0
    for doc_id, text in sorted(rows):
        ids = np.array(plain(text), "<u4")
        out[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_query_against_brute_force(spark, table, plain):
    want = expected([(r.doc_id, r.text) for r in table("documents").collect()], plain)
    found = op8_token_files(spark, SF).collect()
    assert len(found) == len(want) and {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 60_000), st.integers(0, 700), st.integers(0, 2**32 - 1), st.sampled_from(["even", "steep", "repeated"]))
def test_blocks_come_back(vocabulary, n, seed, kind):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, vocabulary, n) if kind == "even" else rng.zipf(1.3, n) % vocabulary
    if kind == "repeated":
        ids = np.resize(ids[:7], n) if n else ids
    assert rangecoder.decode_block(rangecoder.encode_block(ids, vocabulary)).tolist() == ids.tolist()


def test_large_block_and_compression():
    rng = np.random.default_rng(1)
    follows = rng.integers(0, 50_257, (500, 3))
    walk = [0]
    for pick in rng.integers(0, 3, 99_999):
        walk.append(int(follows[walk[-1] % 500, pick]))
    data = rangecoder.encode_block(np.array(walk), 50_257)
    assert rangecoder.decode_block(data).tolist() == walk
    assert 8 * len(data) / len(walk) < 12  # 16 as plain numbers
    same = rangecoder.encode_block(np.full(100_000, 77), 50_257)
    assert len(same) < 25_000 and (rangecoder.decode_block(same) == 77).all()
    with pytest.raises(ValueError):
        rangecoder.encode_block(np.zeros(rangecoder.BLOCK + 1), 10)


def test_damage_is_found():
    ids = np.arange(3000) % 91
    data = rangecoder.encode_block(ids, 100)
    rng = np.random.default_rng(2)
    for at in [0, 5, 9, 13, 17, 21, *rng.integers(20, len(data), 40)]:
        broken = bytearray(data)
        broken[at] ^= 1 << int(rng.integers(8))
        try:
            assert rangecoder.decode_block(bytes(broken)).tolist() == ids.tolist()  # a bit that no lane reads
        except rangecoder.DamagedBlock:
            pass
    for broken in (b"", data[:10], data[:-2], data + b"xx"):
        with pytest.raises(rangecoder.DamagedBlock):
            rangecoder.decode_block(broken)


def test_odd_rows(spark, odd, nothing, plain):
    path = scratch_dir(spark, "test-tokens")
    token_files.write_token_files(odd, definition(), path)
    rows = odd.collect()
    found = token_files.read_documents(spark, path).orderBy("start").collect()
    assert len(found) == len(rows)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    crc = lambda t: zlib.crc32(np.array(plain(t), "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(r.doc_id), len(plain(r.text)), crc(r.text)) for r in rows)
    assert [r.start for r in found] == [sum(f.n_tokens for f in found[:i]) for i in range(len(found))]
    empty = scratch_dir(spark, "test-tokens")
    token_files.write_token_files(nothing, definition(), empty)
    assert token_files.read_documents(spark, empty).count() == 0


def test_documents_longer_than_a_block(spark, plain, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 100)
    monkeypatch.setattr(token_files, "PART_CHARS", 1500)
    rows = [(i, " ".join(f"w{j * i}" for j in range(n))) for i, n in enumerate([5, 400, 0, 31, 32, 33, 90, 1, 120, 3])]
    path = scratch_dir(spark, "test-tokens")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), definition(), path)
    found = token_files.read_documents(spark, path).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected(rows, plain)
    whole = {}
    for r in sorted(token_files.read_pieces(spark, path).collect(), key=lambda r: (r.part, r.block, r.place)):
        whole.setdefault(r.doc_id, []).extend(r.ids)
    assert whole == {i: plain(t) for i, t in rows}


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined_checksums(a, b):
    assert token_files.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("vocabulary", [1, 2, 300, 50_257, 70_000])
def test_first_lookup_of_ids(vocabulary):
    """The decoder's first lookup is a search of the sums; an encoder makes none."""
    model = rangecoder._Model(vocabulary, 4, decoding=True)
    rng = np.random.default_rng(vocabulary)
    for most in (0, 3, 5000):
        model.counts += rng.integers(0, most + 1, vocabulary) * (rng.random(vocabulary) < 0.1)
        model._refresh()
        places = np.arange(0, rangecoder.TOTAL + 1, 1 << rangecoder.COARSE)
        assert np.array_equal(model.first, np.searchsorted(model.sums, places, "right") - 1)
    assert not hasattr(rangecoder._Model(vocabulary, 4), "first")
