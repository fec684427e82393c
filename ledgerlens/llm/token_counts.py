"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton of the vocabulary enumerates the pieces that end at
each character; dynamic programming carries the best score and the number of
pieces on that path, nothing else. Ties go to the piece that starts earlier,
and a character no single-character piece covers costs the lowest score less 10
and counts as its UTF-8 bytes, as in the ``Unigram`` model of the tokenizers
library with byte fallback. Sums are double precision, as there.

Text is cut as ``Metaspace`` does: spaces become the piece mark, one is put in
front unless the text begins with one, and every mark begins a segment. No
piece crosses a segment, so each distinct segment is solved once per batch and
cached per Python worker.

Behaviour on awkward input: null and empty text have 0 tokens and score 0;
repeated rows are counted each; long texts are counted whole; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import Cache, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Score of control, byte and unknown pieces: no path takes one for ordinary text.
NEVER = -1e6


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, by id."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), NEVER if model.is_control(i) or model.is_byte(i) or model.is_unknown(i)
             else model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.has_bytes = {f"<0x{b:02X}>" for b in range(256)} <= {piece for piece, _ in pieces}
        self.cache = Cache(self._solve, np.float64)

    def count(self, segment: str) -> tuple[float, int]:
        """(best score, pieces on the path that the tokenizer takes)."""
        best, pieces = [0.0], [0]
        top, taken, single = None, 0, False
        at = 0
        for end, (length, score) in self.automaton.iter(segment):
            while at < end:  # the characters before this one have had all their pieces
                self._close(segment, best, pieces, top, taken, single)
                top, taken, single, at = None, 0, False, at + 1
            score += best[end + 1 - length]
            if top is None or score > top:  # longer pieces, which start earlier, come first
                top, taken = score, pieces[end + 1 - length] + 1
            single = single or length == 1
        while at < len(segment):
            self._close(segment, best, pieces, top, taken, single)
            top, taken, single, at = None, 0, False, at + 1
        return best[-1], pieces[-1]

    def _close(self, segment, best, pieces, top, taken, single) -> None:
        if not single:
            score = best[-1] + self.unknown
            if top is None or score > top:
                top = score
                taken = pieces[-1] + (len(segment[len(best) - 1].encode()) if self.has_bytes else 1)
        best.append(top)
        pieces.append(taken)

    def _solve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.count(MARK + w) for w in words.to_pylist()]
        return np.array(found, np.float64).reshape(-1), np.arange(len(found) + 1) * 2

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segments, pieces, score) of each text."""
        marked = pc.replace_substring(pc.fill_null(texts, ""), " ", MARK)
        bare = pc.and_(pc.invert(pc.starts_with(marked, MARK)), pc.greater(pc.binary_length(marked), 0))
        marked = pc.if_else(bare, pc.binary_join_element_wise(MARK, marked, ""), marked)
        parts = pc.split_pattern(marked, MARK)
        counts = pc.list_value_length(parts).to_numpy() - 1  # what stands before the first mark is empty
        offsets = parts.offsets.to_numpy().astype(np.int64)
        values = parts.flatten()
        inner = np.ones(len(values), bool)
        inner[offsets[:-1] - offsets[0]] = False
        coded = values.filter(pa.array(inner)).dictionary_encode()
        starts, _ = self.cache.rows(coded.dictionary)
        at = starts[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(counts)])
        of = np.repeat(np.arange(len(counts)), counts)
        score = np.bincount(of, self.cache.values[at], len(counts))
        pieces = np.bincount(of, self.cache.values[at + 1], len(counts))
        return np.diff(ends), pieces.astype(np.int64), score


@functools.cache
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(vocabulary(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_segments, n_tokens, score`` of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = counter(path)
        for batch in slices(batches, "text"):
            segments, pieces, score = unigram.totals(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(segments, pa.int64()), pa.array(pieces), pa.array(score)],
                ["doc_id", "n_segments", "n_tokens", "score"])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, n_segments bigint, n_tokens bigint, score double")
