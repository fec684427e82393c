"""Best-fit packing of documents into training sequences of bounded length.

Bounded-space online best-fit: a task keeps a fixed number of open sequences,
indexed by their free space in the bits of one integer. A piece goes to the
open sequence with the least free space that holds it; when one too many is
open, the fullest closes. Pieces meet the packer an Arrow batch at a time, the
longer ones first. Tasks pack their own rows, and sequence numbers carry the
partition in their high bits. What a task leaves open at its end (at most so many
sequences) is taken apart: those pieces, small rows without text, are shuffled to
few tasks, which pack them anew, longest first, with every sequence kept open.

Token ids are those of a BPE tokenizer file with word ends. Text is lower-cased
and normalised as the file says, cut by :mod:`pretokenize` and merged by
:mod:`merges`; texts beyond the plain Latin blocks go through the tokenizer
library's own normaliser first. With ``added_tokens``, as the library does at its
defaults, the file's added tokens (such as ``<|endoftext|>``) inside a text are cut
out before normalising and stand as their own ids; without, they are ordinary text.

Behaviour on awkward input: null and empty texts are one piece holding the
end token only; a null id is carried through; repeated rows are packed each;
long texts are cut into full pieces, only the last is shorter; an empty
table packs nothing; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import Cache, buffers, gather, slices
from ledgerlens.llm.merges import PairTable, merge_words
from ledgerlens.llm.pretokenize import tokens
from ledgerlens.llm.tables import stored

#: Sequences a task keeps open.
OPEN_BINS = 256
#: Sequences left open by the tasks that one task packs anew.
LEFT_BINS = 4096


class BestFit:
    """Open sequences keyed by free space."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free = 0  # bit f: some open sequence has f tokens free
        self.bins: dict[int, list[int]] = {}
        self.open, self.made = 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        fitting = self.free >> length << length
        if fitting:
            space = (fitting & -fitting).bit_length() - 1
            which = self._take(space)
        else:
            space, which, self.made = self.capacity, self.made, self.made + 1
        if space > length:
            self.bins.setdefault(space - length, []).append(which)
            self.free |= 1 << space - length
            self.open += 1
            if self.open > self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
        return which, self.capacity - space

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        which = stack.pop()
        if not stack:
            del self.bins[space]
            self.free ^= 1 << space
        self.open -= 1
        return which


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """BPE with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("added tokens that are normalised, strip white space or are single words are not supported")
        # Of those that begin at the same place the longest is taken.
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=lambda t: (-len(t), t)))) or r"(?!)")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], range(len(pairs)),
                               [ids[a + b] for a, b in pairs])
        # The normaliser alone: the library need not hold the vocabulary too.
        bare = {**file, "added_tokens": [], "post_processor": None, "model": {**model, "vocab": {}, "merges": []}}
        self.normalise = Tokenizer.from_str(json.dumps(bare)).normalizer.normalize_str
        self.cache = Cache(self._merge)

    def _merge(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = buffers(strings)
        symbols = self.inner[data]
        symbols[offsets[1:] - 1] = self.final[data[offsets[1:] - 1]]
        return merge_words(symbols, offsets, self.pairs)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        texts = pc.fill_null(texts, "")
        # Below U+0300 no character composes with its neighbours, and all but
        # U+0130 have a lower case of one character.
        special = pc.match_substring_regex(texts, "[^\\x00-\\x{12F}\\x{131}-\\x{2FF}]")
        lower = pc.utf8_lower(texts)
        if pc.any(special).as_py():
            lower = pa.array([self.normalise(t) if s else x for t, s, x in
                              zip(texts.to_pylist(), special.to_pylist(), lower.to_pylist())], pa.string())
        distinct, index, of_text = tokens(lower, attach=False)
        starts, ends = self.cache.rows(distinct)
        at, offsets = gather(starts[index], ends[index])
        return self.cache.values[at], offsets[of_text]

    def encode_with_added(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the added tokens inside the texts as their own ids."""
        texts = pc.fill_null(texts, "")
        holding = np.zeros(len(texts), bool)
        for token in self.added:
            holding |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not holding.any():
            return self.encode(texts)
        parts, own, counts = [], [], []  # own: the id of the added token after each part, or -1
        for text, held in zip(texts.to_pylist(), holding.tolist()):
            marks = self.cut.findall(text) if held else []
            parts += self.cut.split(text) if held else [text]
            own += [self.added[m] for m in marks] + [-1]
            counts.append(len(marks) + 1)
        ids, offsets = self.encode(pa.array(parts, pa.string()))
        own = np.array(own, np.int64)
        marked = own >= 0
        after = offsets + np.concatenate([[0], np.cumsum(marked)])
        out = np.empty(after[-1], ids.dtype)
        place = after[1:][marked] - 1
        plain = np.ones(after[-1], bool)
        plain[place] = False
        out[plain], out[place] = ids, own[marked]
        return out, after[np.concatenate([[0], np.cumsum(counts)])]


@functools.cache
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end token after every document."""
    count = len(offsets) - 1
    after = offsets + np.arange(count + 1)
    out = np.full(after[-1], end, np.uint32)
    last = np.zeros(after[-1], bool)
    last[after[1:] - 1] = True
    out[~last] = ids
    return out, after


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", open_bins: int = OPEN_BINS, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, if asked, its ``ids``."""
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = tokenizer(path), BestFit(capacity, open_bins)
        encode = bpe.encode_with_added if added_tokens else bpe.encode
        base = TaskContext.get().partitionId() << 40
        held = None  # rows whose sequence is still open
        for batch in slices(batches, "text"):
            ids, offsets = with_end(*encode(batch.column("text")), end_id)
            counts = -(-np.diff(offsets) // capacity)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            piece = gather(np.zeros(len(counts), np.int64), counts)[0]
            start = piece * capacity
            length = np.minimum(np.diff(offsets)[doc] - start, capacity)
            begin = offsets[:-1][doc] + start
            place = np.empty((len(doc), 2), np.int64)
            for i in np.argsort(-length, kind="stable").tolist():
                place[i] = packer.place(int(length[i]))
            data = ids.astype("<u4")
            crc = [zlib.crc32(data[a:a + n]) for a, n in zip(begin.tolist(), length.tolist())]
            out = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                   pa.array(length), pa.array(crc, pa.int64()), pa.array(place[:, 0] + base), pa.array(place[:, 1])]
            if with_ids:
                out.append(pa.ListArray.from_arrays(np.append(begin, offsets[-1]).astype(np.int32), ids.astype(np.int32)))
            rows = pa.Table.from_arrays(out, names)
            rows = rows if held is None else pa.concat_tables([held, rows])
            still = np.array([w for stack in packer.bins.values() for w in stack], np.int64) + base
            is_open = pc.is_in(rows.column("sequence_id"), value_set=pa.array(still))
            yield from _marked(rows.filter(pc.invert(is_open)), False)
            held = rows.filter(is_open).combine_chunks()
        if held is not None:
            yield from _marked(held, True)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = BestFit(capacity, 1 << 62), 1 << 62 | TaskContext.get().partitionId() << 40
        for batch in batches:
            place = np.array([packer.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            columns = {name: batch.column(name) for name in names} | {"sequence_id": pa.array(place[:, 0] + base), "offset": pa.array(place[:, 1])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    schema = (f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint, "
              "sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    packed = stored(texts.mapInArrow(run, schema + ", open boolean"), "packed")
    left = packed.where("open").drop("open")
    # Whether a sequence's first piece is here tells the sequences apart without a shuffle.
    count = left.where("offset = 0").count()
    dealt = left.repartition(-(-count // LEFT_BINS) or 1, "sequence_id").sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    return packed.where("NOT open").drop("open").unionByName(dealt.mapInArrow(again, schema))


def _marked(rows: pa.Table, is_open: bool) -> list[pa.RecordBatch]:
    return rows.append_column("open", pa.array(np.full(len(rows), is_open))).to_batches()
