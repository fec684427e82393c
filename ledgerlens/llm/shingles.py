"""Sets of word shingles as sorted 64-bit hashes, computed on Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlens.llm.arrow import buffers, distinct_words

_FNV, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """FNV-1a of each word's bytes, mixed; all words advance together a byte at a time."""
    offsets, data = buffers(words)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = offsets[:-1][order], lengths[order]
    hashes = np.full(len(order), _FNV, np.uint64)
    longer = len(order)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        longer = int(np.searchsorted(-sizes, -i, side="left"))  # words with more than i bytes
        hashes[:longer] = (hashes[:longer] ^ data[begins[:longer] + i]) * _PRIME
    out = np.empty(len(order), np.uint64)
    out[order] = hashes
    return mixed(out)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct k-word shingles, ascending. A-Z count as a-z; with fewer words
    the whole sequence is one shingle, without words there is none."""
    words, index, at = distinct_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = word_hashes(words)[index]
    counts = np.diff(at)
    doc = np.repeat(np.arange(len(counts)), counts)
    size = np.minimum(counts, k)
    starts = np.flatnonzero(np.arange(len(hashes)) + size[doc] <= at[1:][doc])
    rolled = mixed(hashes[starts], 1)
    for j in range(1, k):
        within = size[doc[starts]] > j
        rolled[within] = mixed(rolled[within] * np.uint64(31) + hashes[starts[within] + j], j + 1)
    doc = doc[starts]
    order = np.lexsort((rolled, doc))
    rolled, doc = rolled[order], doc[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (doc[1:] != doc[:-1])
    return rolled[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(counts)))])
