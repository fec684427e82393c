"""Byte-level BPE encoding and decoding.

A task cuts its texts into pre-tokens with :mod:`pretokenize` (class arrays
and a scan, no regular expressions), merges each distinct pre-token once
(:mod:`merges`, results cached per Python worker) and lays the ids of all
texts out in one array with offsets, from which each text is decoded again.

Behaviour on awkward input: null text is the empty text, with no ids and
empty bytes; repeated rows and ids give repeated result rows; long texts are
encoded whole; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import Cache, buffers, gather, slices
from ledgerlens.llm.merges import PairTable, merge_words
from ledgerlens.llm.pretokenize import tokens


class ByteBpe:
    """The tokenizer of a rank file: one line for each token, base64 of its bytes and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(t): int(r) for t, r in lines}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.vocabulary = pa.array(list(ranks), pa.binary())
        self.ranks = np.fromiter(ranks.values(), np.int64, len(ranks))
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items()
                 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank, rank)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.cache = Cache(self._merge)

    def _merge(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: the whole piece where it is a token, else by merging."""
        offsets, data = buffers(strings)
        whole = pc.index_in(strings.cast(pa.binary()), value_set=self.vocabulary)
        known = pc.is_valid(whole).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~known)
        at, ends = gather(offsets[rest], offsets[rest + 1])
        merged, merged_ends = merge_words(self.first[data[at]], ends, self.pairs)
        counts = np.ones(len(strings), np.int64)
        counts[rest] = np.diff(merged_ends)
        out_ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(out_ends[-1], np.int64)
        out[out_ends[:-1][known]] = self.ranks[pc.fill_null(whole, 0).to_numpy()[known]]
        out[gather(out_ends[rest], out_ends[rest + 1])[0]] = merged
        return out, out_ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        distinct, index, of_text = tokens(pc.fill_null(texts, ""), attach=True)
        starts, ends = self.cache.rows(distinct)
        at, offsets = gather(starts[index], ends[index])
        return self.cache.values[at], offsets[of_text]

    def decode(self, ids: np.ndarray) -> bytes:
        at, _ = gather(self.begins[ids], self.begins[ids] + self.lengths[ids])
        return self.bytes[at].tobytes()

    @functools.cached_property
    def decimals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, bytes) of every id in decimal with a space after it."""
        words = [b"%d " % i for i in range(len(self.pieces))]
        ends = np.cumsum([len(w) for w in words])
        return ends - [len(w) for w in words], ends, np.frombuffer(b"".join(words), np.uint8)


@functools.cache
def tokenizer(path: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: the ids of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in slices(batches, "text"):
            ids, offsets = bpe.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(offsets.astype(np.int32), ids)], ["doc_id", "ids"])
    return _columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {_type(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded binary``: the bytes of each row of ids (null: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            rows = [bpe.decode(np.asarray(x if x is not None else [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256`` without carrying the ids through Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        from_, to, digits = bpe.decimals
        for batch in slices(batches, "text"):
            ids, offsets = bpe.encode(batch.column("text"))
            ids_sha, text_sha = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = ids[a:b]
                written = digits[gather(from_[own], to[own])[0]][:-1]
                ids_sha.append(hashlib.sha256(written.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _columns(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def _type(docs: DataFrame, id_col: str) -> str:
    return dict(docs.dtypes)[id_col]
