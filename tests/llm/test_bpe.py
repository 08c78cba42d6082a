"""Operator 6 against the tiktoken library and against the merges themselves."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, PATTERN)


def ids_of(codec, text):
    return list(memoryview(codec.encode([text])[0]).cast("I"))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=st.sampled_from(list("ab'tsre 1,.\n\t\x1c\x85 　é!<|>aaaßöüñ日本")), max_size=60)))
def test_encodes_as_the_library(text):
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.codec(PATH, PATTERN).transducer.ranks, special_tokens={})
    assert ids_of(bpe.codec(PATH, PATTERN), text) == lib.encode_ordinary(text)


def test_long_pieces(codec, library):
    rng = random.Random(5)
    for letters in ("a", "ab", "aeiou", "étaonrs", "日本語"):
        text = "".join(rng.choice(letters) for _ in range(5000))
        assert ids_of(codec, text) == library.encode_ordinary(text)
    text = " " * 3001 + "\n" * 1000 + "=" * 777
    assert ids_of(codec, text) == library.encode_ordinary(text)


def test_long_pieces_are_emitted_after_a_lookahead(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "LOOKAHEAD", 60)
    rng = random.Random(6)
    for letters in ("ab", "etaoinshr", "thequickbrown"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        assert ids_of(bpe.Codec(PATH, PATTERN), text) == library.encode_ordinary(text)


def test_a_small_vocabulary_with_overlaps():
    ranks = {bytes([b]): b for b in range(256)}
    for k, t in enumerate([b"aa", b"ab", b"aaa", b"ba", b"aab", b"abab", b"bab", b"aaaa"]):
        ranks[t] = 256 + k
    t = bpe.Transducer(ranks)
    rng = random.Random(2)
    for _ in range(3000):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert t.encode(piece) == ([ranks[piece]] if piece in ranks else t.merged(piece))


def test_states_may_be_forgotten(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    fresh = bpe.Codec(PATH, PATTERN)
    text = "some ordinary words, unlikelyhood and so on; äöü"
    assert ids_of(fresh, text) == library.encode_ordinary(text)


def test_stretches_that_are_no_plain_words(library):
    text = "a 1st b-c  d 2,000 (e) f's <g> 9 h. i, ünder_score 日本 j!" * 3
    assert ids_of(bpe.Codec(PATH, PATTERN), text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12))
def test_utf8_machine(data):
    state = 0
    for b in data:
        state = bpe.utf8_step(state, b)
        if state < 0:
            break
    try:
        data.decode()
        good = True
    except UnicodeDecodeError:
        good = False
    assert (state == 0) == good


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30), st.integers(1, 5))
def test_stream_passes_whole_characters(text, chunk):
    c = bpe.codec(PATH, PATTERN)
    parts = list(bpe._stream(c.transducer.tokens, [{} for _ in range(8)], c.encode([text])[0], chunk))
    assert "".join(p.decode() for p in parts) == text


def test_stream_tells_bad_ids():
    d = bpe.StreamDecoder({0: b"\xe3\x81", 1: b"a"})
    assert d.feed([0]) == b""
    with pytest.raises(ValueError):
        d.feed([1])
    d = bpe.StreamDecoder({0: b"\xe3\x81"})
    d.feed([0])
    with pytest.raises(ValueError):
        d.finish()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = library.encode_ordinary(d.text)
        want[d.doc_id] = len(ids), sha(",".join(map(str, ids))), sha(d.text)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe_transducer(spark, SF).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "no id", "x"), (5, "long " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(df, PATH, PATTERN)
    got = bpe.digests(df, PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted((str(i), sha(t or "")) for i, t, _ in rows)
    assert {r.text for r in bpe.decode(encoded, PATH, PATTERN).collect()} == {"", "no id", "long " * 20000}
    assert bpe.digests(df.limit(0), PATH, PATTERN).count() == 0 and bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
