"""Pre-tokenisation, byte-level BPE, packing and unigram counts against the public libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from ledgerlens.llm import byte_bpe, packing, queries, token_counts
from ledgerlens.llm.merges import PairTable, merge_words
from ledgerlens.llm.pretokenize import IDENTITY, prefix_functions, tokens
from tests.llm.conftest import ROWS, frame

ALPHABET = list("'''''  \n\tstmdrevlLE abc12!?.é　\x85\x1c²\U0001F600ǅİΣςßŉ") + ["<|endoftext|>", "<s>", "<0x0A>"]
TEXT = st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join)
ATTACHED = regex.compile(public_tokenizers.PATTERN)
SINGLE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
RANKS, WORDS, PIECES = (public_tokenizers.path(p) for p in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def reference_bytes():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def reference_words():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_slices_are_those_of_the_patterns(texts):
    for attach, pattern in ((True, ATTACHED), (False, SINGLE)):
        distinct, index, at = tokens(pa.array(texts, pa.string()), attach)
        distinct = distinct.to_pylist()
        assert [[distinct[i] for i in index[a:b]] for a, b in zip(at, at[1:])] == [pattern.findall(t) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=400))
def test_scan_composes_in_order(steps):
    got, state = prefix_functions(np.array(steps, np.uint8), block=4), list(range(4))
    for f, g in zip(steps, got):
        state = [f >> 2 * s & 3 for s in state]
        assert [int(g) >> 2 * s & 3 for s in range(4)] == state
    assert [IDENTITY >> 2 * s & 3 for s in range(4)] == [0, 1, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=90), min_size=1, max_size=8))
def test_merges_take_the_leftmost_lowest_pair(words):
    pairs = {(0, 1): (2, 2), (1, 0): (1, 3), (2, 2): (0, 4), (3, 3): (5, 5), (4, 0): (3, 6)}  # (rank, result)
    table = PairTable(*zip(*pairs), *zip(*pairs.values()))

    def plain(s):
        while True:
            best = min(((pairs[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in pairs), default=None)
            if best is None:
                return s
            i = best[1]
            s = s[:i] + [pairs[s[i], s[i + 1]][1]] + s[i + 2:]

    symbols = [["ab".index(c) for c in w] for w in words]
    out, at = merge_words(np.array([x for s in symbols for x in s], np.int64), np.cumsum([0, *map(len, symbols)]), table)
    assert [out[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(s) for s in symbols]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_both_tokenizers_equal_their_libraries(reference_bytes, reference_words, texts):
    for own, reference in ((byte_bpe.tokenizer(RANKS), reference_bytes.encode_ordinary),
                           (packing.tokenizer(WORDS), lambda t: reference_words.encode(t, add_special_tokens=False).ids)):
        ids, at = own.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference(t) for t in texts]


@pytest.mark.parametrize("form", ["{}'s", "a {}", "1{}2"])
def test_every_code_point_equals_both_libraries(reference_bytes, form):
    points = [form.format(chr(i)) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["\n".join(points[i:i + 512]) for i in range(0, len(points), 512)]
    ids, at = byte_bpe.tokenizer(RANKS).encode(pa.array(texts))
    want = reference_bytes.encode_ordinary_batch(texts)
    assert np.array_equal(np.diff(at), [len(w) for w in want]) and np.array_equal(ids, [i for w in want for i in w])
    library = Tokenizer.from_file(WORDS)
    ids, at = packing.tokenizer(WORDS).encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert np.array_equal(np.diff(at), [len(w) for w in want]) and np.array_equal(ids, [i for w in want for i in w])


def test_cache_limit_changes_nothing(reference_bytes):
    own = byte_bpe.ByteBpe(RANKS)
    own.cache.limit = 5
    for text in ("some words here and there", "other words now", "some words here and there", "x" * 500 + " the" * 300):
        ids, _ = own.encode(pa.array([text]))
        assert ids.tolist() == reference_bytes.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_round_trip_query(spark, awkward, nothing, reference_bytes):
    got = sorted(map(tuple, byte_bpe.round_trip(awkward, RANKS).collect()), key=repr)
    want = []
    for i, text in ROWS:
        ids = reference_bytes.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    encoded = byte_bpe.encode(awkward, RANKS)
    assert sorted(bytes(r["decoded"]) for r in byte_bpe.decode(encoded, RANKS).collect()) == sorted((t or "").encode() for _, t in ROWS)
    assert byte_bpe.round_trip(nothing, RANKS).collect() == []


def test_packing(spark, awkward, nothing, reference_words):
    rows = packing.pack(awkward, WORDS, capacity=256, open_bins=3, with_ids=True).collect()
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 256
        docs[r["doc_id"]].append(r)
    for places in bins.values():  # gapless from 0
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    want = defaultdict(list)
    for i, text in ROWS:
        want[i] += reference_words.encode(text or "", add_special_tokens=False).ids + [0]
    for i, pieces in docs.items():
        assert sum(r["length"] for r in pieces) == len(want[i])
        if sum(j == i for j, _ in ROWS) == 1:
            pieces.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in pieces] == list(range(len(pieces))) and [r["start"] for r in pieces] == [256 * k for k in range(len(pieces))]
            assert [x for r in pieces for x in r["ids"]] == want[i]
            assert all(r["length"] == 256 for r in pieces[:-1])
    assert set(docs) == {i for i, _ in ROWS}
    assert packing.pack(nothing, WORDS).collect() == []
    with pytest.raises(ValueError):
        packing.pack(nothing, WORDS, capacity=0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ALPHABET, "<|startoftext|>", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|", "\u0301"]), max_size=40).map("".join),
                min_size=1, max_size=5))
def test_added_tokens_equal_the_library_at_its_defaults(texts):
    library = Tokenizer.from_file(WORDS)
    ids, at = packing.tokenizer(WORDS).encode_with_added(pa.array([*texts, None], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def test_queries_pack_added_tokens(spark, scratch):
    library = Tokenizer.from_file(WORDS)
    rows = [(1, "a <|endoftext|> b"), (2, "<|startoftext|>" * 3000), (3, "no mark"), (4, None)]
    frame(spark, rows).write.parquet(f"{scratch}/documents.parquet")
    docs = spark.read.parquet(f"{scratch}/documents.parquet")
    want = {}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want |= {(i, k): (len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate([ids[a:a + 2048] for a in range(0, len(ids), 2048)])}
    assert library.encode(rows[0][1], add_special_tokens=False).ids == [320, 49407, 321]
    for packed in (queries.op9_best_fit_packing(spark, scratch), corpus_pipeline.pack(spark, docs, scratch)):
        assert {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in packed.collect()} == want


def test_number_of_sequences_does_not_grow_with_the_partitions(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["one", "two", "three", "four"], k=rng.randint(1, 120)))) for i in range(600)]
    made = {}
    for parts in (1, 40):
        got = packing.pack(frame(spark, rows).repartition(parts, "doc_id"), WORDS, capacity=1024, open_bins=64).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(600))
        ends = defaultdict(int)
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == ends[r["sequence_id"]]
            ends[r["sequence_id"]] += r["length"]
        assert max(ends.values()) <= 1024
        made[parts] = len(ends)
    tokens_ = sum(len(t.split()) + 1 for _, t in rows)
    assert -(-tokens_ // 1024) <= made[40] <= made[1] + 1


def test_best_fit_against_plain_search():
    rng = random.Random(3)
    own, open_, made = packing.BestFit(100, 4), {}, 0
    for _ in range(2000):
        n = rng.randint(1, 100)
        which, offset = own.place(n)
        fitting = [(free, b) for b, free in open_.items() if free >= n]
        if fitting:
            free = min(fitting)[0]
            assert open_[which] == free
        else:
            free = 100
            assert which == made
            made += 1
        assert offset == 100 - free
        open_.pop(which, None)
        if free > n:
            open_[which] = free - n
            if len(open_) > 4:  # the fullest closes
                least = min(open_.values())
                gone = [b for b, f in open_.items() if f == least and b not in own.bins.get(least, [])]
                assert len(gone) == 1
                del open_[gone[0]]


@pytest.fixture(scope="module")
def reference_unigram():
    t = Tokenizer(models.Unigram(token_counts.vocabulary(PIECES), 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return t


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_counts_equal_the_library(reference_unigram, texts):
    _, pieces, _ = token_counts.counter(PIECES).totals(pa.array(texts, pa.string()))
    assert pieces.tolist() == [len(reference_unigram.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ties_and_unknown_characters():
    pieces = [("<unk>", -50.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -3.0)]
    own = token_counts.UnigramCounter(pieces)
    library = Tokenizer(models.Unigram(pieces, 0, False))
    for word in ("▁", "▁a", "▁aa", "▁aaaa", "▁abba", "▁aab"):
        assert own.count(word)[1] == len(library.encode(word, add_special_tokens=False).ids), word
    assert own.count("▁x")[0] == -1.0 - 60.0


def test_count_query(spark, awkward, nothing, reference_unigram):
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(awkward, PIECES).collect()), key=repr)
    assert got == sorted(((i, len(reference_unigram.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS), key=repr)
    assert token_counts.token_counts(nothing, PIECES).collect() == []
