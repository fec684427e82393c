"""SentencePiece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import queries, sentence_piece
from tests.llm.conftest import ROWS, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("     aaeehlnorst.,'1\n\t▁▁é中文\x00\U0001F600́ΣҢ") + ["the ", " of", "<s>", "</s>", "<0x0A>", "<unk>", "  ", "        ", "⁇"]
TEXT = st.lists(st.one_of(st.sampled_from(ALPHABET), st.characters(codec="utf-8")), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return sentence_piece.PieceBpe(MODEL)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=6))
def test_ids_and_texts_equal_the_library(library, own, texts):
    ids, offsets = own.encode(pa.array(texts, pa.string()))
    rows = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert rows == [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [own.decode(r).decode() for r in rows] == [library.decode(r) for r in rows]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 300), st.sampled_from([0, 1, 2, 28705, 259, 260])), max_size=12))
def test_decoding_of_any_ids_equals_the_library(library, own, ids):
    assert own.decode(ids).decode() == library.decode(ids)


def test_every_code_point_equals_the_library(library, own):
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["a".join(points[i:i + 64]) for i in range(0, len(points), 64)]
    ids, offsets = own.encode(pa.array(texts, pa.string()))
    theirs = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == theirs


def test_long_texts_without_spaces(library, own):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdeinst", k=20_000)), " " * 5_000, "▁a" * 3_000, "日本" * 4_000]
    ids, offsets = own.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_bos=True, add_eos=True) for t in texts]


def test_cache_limit_and_whole_texts_change_nothing(library):
    texts = [f"wort{i} satz{i % 7}  x" for i in range(200)]
    for limit, whole in ((5, False), (5, True)):
        own = sentence_piece.PieceBpe(MODEL)
        own.cache.limit, own.whole = limit, whole
        for _ in range(3):
            ids, offsets = own.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_bos=True, add_eos=True) for t in texts]


def test_round_trip_query(spark, awkward, nothing, library):
    got = sentence_piece.round_trip(awkward, MODEL, checked=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sentence_piece.round_trip(nothing, MODEL).collect() == []


def test_encode_and_decode_tables(spark, awkward, nothing, library):
    encoded = sentence_piece.encode(awkward, MODEL)
    decoded = sentence_piece.decode(encoded, MODEL)
    assert sorted(map(tuple, decoded.collect()), key=repr) == sorted(((i, (t or "").replace("▁", " ")) for i, t in ROWS), key=repr)
    assert sentence_piece.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()[0]["decoded"] == ""
    assert sentence_piece.encode(nothing, MODEL).collect() == []


def test_query_agrees_with_the_library_on_every_document(spark):
    from tests.conftest import SF_SMALL
    got = queries.QUERIES["op13_sentence_piece"](spark, SF_SMALL)
    assert got.where("NOT agrees").isEmpty() and not got.isEmpty()
    assert frame(spark).columns  # clashing names are in `awkward`, above
