"""SentencePiece encoding and decoding with a merge-type vocabulary.

A text's spaces become the piece mark and one mark is put in front. Its symbols,
single characters at first, are merged along an agenda of adjacent pairs: the
pair whose joined piece has the highest score comes first, of equal ones the
leftmost. The agendas of a batch's segments are worked off side by side
(:mod:`merges`): a row of a matrix holds the waiting pairs of one segment, and each
step takes the best of every row; a long segment has a heap, in which a pair is
passed over if one of its symbols has since changed. What no piece covers in the
end is written as its UTF-8 bytes.

No piece of such a vocabulary has the mark after another character, so no merge
crosses the beginning of a run of marks: each distinct segment between these
places goes through the agenda once and is cached per Python worker. A
vocabulary with other pieces is worked on whole texts.

``checked`` runs the sentencepiece library over the same Arrow batches and says
for each row whether it gives the same ids and the same decoded text.

Behaviour on awkward input: null and empty texts have the begin and end ids
only and decode to the empty text; repeated rows and ids give repeated result
rows; long texts are encoded whole; the mark itself and the strings of control
and byte pieces inside a text are ordinary characters (the mark decodes to a
space); an empty table gives an empty result; only the id and text columns are
read.
"""

from __future__ import annotations

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
from ledgerlens.llm.pretokenize import code_points

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Kind of model: pairs merged by score.
MERGES = 2


class PieceBpe:
    """The tokenizer of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if (trained.model_type != MERGES or not trained.byte_fallback or trained.treat_whitespace_as_suffix
                or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces
                or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("need a merge-type model with byte fallback, without normalisation or symbols of its user")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.begin, self.end = trained.bos_id, trained.eos_id
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        self.of_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.is_control = np.array([kind == CONTROL for _, _, kind in pieces])
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.whole = any(MARK in p.lstrip(MARK) for p in normal)
        # Symbols: pieces by their id, characters that are no piece by ``size`` plus their code point.
        self.symbol = np.arange(0x110000) + len(pieces)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        place = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in normal.values()}, reverse=True))}
        known = normal | {c: int(self.symbol[ord(c)]) for p in normal for c in p}
        joins = [(known[p[:k]], known[p[k:]], place[pieces[i][1]], i)
                 for p, i in normal.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        self.pairs = PairTable(*np.array(joins, np.int64).reshape(-1, 4).T)
        self.size = len(pieces)
        surface = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE
                   else trained.unk_surface.encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.opens = np.array([kind == NORMAL and p.startswith(MARK) for p, _, kind in pieces])
        self.lengths = np.array([len(s) for s in surface], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.cache = Cache(self._solve)

    def _solve(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the agendas of distinct segments, worked off side by side."""
        points, offsets, _ = code_points(segments)
        symbols, ends = merge_words(self.symbol[points], offsets, self.pairs)
        bare = np.flatnonzero(symbols >= self.size)
        if not len(bare):
            return symbols, ends
        spelt = [[self.of_byte[b] for b in chr(s).encode()] for s in (symbols[bare] - self.size).tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[bare] = [len(x) for x in spelt]
        after = np.concatenate([[0], np.cumsum(counts)])
        out = np.repeat(symbols, counts)
        out[gather(after[bare], after[bare + 1])[0]] = [i for x in spelt for i in x]
        return out, after[ends]

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct segments, index of each segment, offsets of the texts in it); an empty text has none."""
        marked = pc.replace_substring(texts, " ", MARK)
        full = pc.greater(pc.binary_length(texts), 0)
        marked = pc.if_else(full, pc.binary_join_element_wise(self.prefix, marked, ""), marked)
        offsets, data = buffers(marked)
        starts = np.zeros(len(data) + 1, bool)
        if not self.whole and len(data) > 2:
            a, b, c = MARK.encode()
            is_mark = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            starts[:len(data) - 2] = is_mark
            starts[3:len(data) - 2] &= ~is_mark[:-3]  # a mark after a mark belongs to its run
        starts[offsets] = True
        starts[-1] = False
        places = np.flatnonzero(starts)
        made = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(data)).astype(np.int32)),
                                           pa.py_buffer(data.tobytes()))
        coded = made.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(places, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their begin and end ids, offsets of each text in them)."""
        distinct, index, of_text = self.segments(pc.fill_null(texts, ""))
        starts, ends = self.cache.rows(distinct)
        at, offsets = gather(starts[index], ends[index])
        inner = offsets[of_text]
        outer = inner + 2 * np.arange(len(inner))
        out = np.empty(outer[-1], np.int32)
        plain = np.ones(len(out), bool)
        plain[outer[:-1]] = plain[outer[1:] - 1] = False
        out[plain] = self.cache.values[at]
        out[outer[:-1]], out[outer[1:] - 1] = self.begin, self.end
        return out, outer

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the ids; bytes that are no characters become U+FFFD, one each."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.is_control[ids]]
        raw = self.bytes[gather(self.begins[ids], self.begins[ids] + self.lengths[ids])[0]].tobytes()
        if len(ids) and self.prefix and self.opens[ids[0]]:
            raw = raw[1:]
        if not self.is_byte[ids].any():
            return raw
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return _repaired(raw)


def _repaired(raw: bytes) -> bytes:
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[i:i + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[i:i + size])
            i += size
            break
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


@functools.cache
def tokenizer(path: str) -> PieceBpe:
    """One for each Python worker."""
    return PieceBpe(path)


@functools.cache
def library(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
            f"doc_id {dict(docs.dtypes)[id_col]}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: the ids of each whole text, begin and end ids included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, offsets = tokenizer(path).encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(offsets.astype(np.int32), ids)], ["doc_id", "ids"])
    rows, id_type = _columns(docs, id_col, text_col)
    return rows.mapInArrow(run, f"{id_type}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded string``: the text of each row of ids (null: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tokenizer(path).decode(x or []).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.string())], ["doc_id", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", checked: bool = False) -> DataFrame:
    """Encode and decode each whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if ``checked``, whether
    the library ``agrees``, without carrying the ids through Spark."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["agrees"] * checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in slices(batches, "text"):
            ids, offsets = bpe.encode(batch.column("text"))
            ids_sha, text_sha, agrees = [], [], []
            for a, b, text in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("text")):
                own = ids[a:b]
                decoded = bpe.decode(own)
                ids_sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if checked:
                    theirs = library(path).encode(text.as_py() or "", add_bos=True, add_eos=True)
                    agrees.append(own.tolist() == theirs and decoded.decode() == library(path).decode(theirs))
            out = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(agrees, pa.bool_())] * checked, names)
    rows, id_type = _columns(docs, id_col, text_col)
    return rows.mapInArrow(run, f"{id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                           + ", agrees boolean" * checked)
