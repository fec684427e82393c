"""Byte-pair merging of many short words at once, with numpy.

Each step merges, in every unfinished word of a block, the leftmost pair of
the lowest rank, which is what the tokenizer libraries do word by word. A word
is a row of a matrix with links between its living symbols. Long words take
the same rule with a heap.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Longer words (in symbols) are merged one at a time.
WIDEST = 48
_NONE = np.int64(1) << 60


class PairTable:
    """(left symbol, right symbol) -> (rank, merged symbol), by open addressing."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.bits = max(4, int(len(left)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int64)
        keys, todo = left << 32 | right, np.arange(len(left))
        rank, merged = np.asarray(rank, np.int64), np.asarray(merged, np.int64)
        slot = self._slot(keys)
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last wins
            won = free[self.keys[slot[free]] == keys[free]]
            self.ranks[slot[won]], self.merged[slot[won]] = rank[won], merged[won]
            done = np.zeros(len(left), bool)
            done[won] = True
            todo = todo[~done[todo]]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, or a very large number; merged symbol)."""
        keys = left << 32 | right
        slot = self._slot(keys)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != -1)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.ranks[slot], _NONE), self.merged[slot]


def _merge_long(symbols: list[int], table: PairTable) -> list[int]:
    """One long word: a heap of (rank, position) over linked symbols."""
    n = len(symbols)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def push(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and nxt[i] < n]
        if lefts:
            rank, merged = table.find(np.array([symbols[i] for i in lefts], np.int64),
                                      np.array([symbols[nxt[i]] for i in lefts], np.int64))
            for i, r, m in zip(lefts, rank.tolist(), merged.tolist()):
                if r < _NONE:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[nxt[i]], m))

    heap: list = []
    push(list(range(n - 1)))
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j], nxt[i] = m, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        push([prv[i], i])
    return [s for s, a in zip(symbols, alive) if a]


def _merge_block(words: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """words: a row of symbols each. Returns (rows, which symbols remain)."""
    count, width = words.shape
    place = np.arange(width)
    sym = words.astype(np.int64)
    live = place < lengths[:, None]
    nxt = np.broadcast_to(place + 1, (count, width)).copy()
    prv = np.broadcast_to(place - 1, (count, width)).copy()
    best = np.full((count, width), _NONE, np.int64)  # rank of the pair that begins here, with its place
    r, c = np.nonzero(place < lengths[:, None] - 1)
    merged = np.zeros((count, width), np.int64)
    found, merged[r, c] = table.find(sym[r, c], sym[r, c + 1])
    best[r, c] = np.where(found < _NONE, found << 6 | c, _NONE)
    rows = np.arange(count)
    while len(rows):
        low = best[rows].min(axis=1)
        rows, low = rows[low < _NONE], low[low < _NONE]
        if not len(rows):
            break
        p = low & 63
        q = nxt[rows, p]
        sym[rows, p] = merged[rows, p]
        live[rows, q] = False
        best[rows, q] = _NONE
        after = nxt[rows, q]
        nxt[rows, p] = after
        more = after < lengths[rows]
        prv[rows[more], after[more]] = p[more]
        best[rows, p] = _NONE
        back = prv[rows, p]
        has = back >= 0
        for row, a, b in ((rows[more], p[more], after[more]), (rows[has], back[has], p[has])):
            found, made = table.find(sym[row, a], sym[row, b])
            best[row, a] = np.where(found < _NONE, found << 6 | a, _NONE)
            merged[row, a] = made
    return sym, live


def merge_words(symbols: np.ndarray, offsets: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word ``symbols[offsets[i]:offsets[i + 1]]``; the same form back."""
    lengths = np.diff(offsets)
    counts = np.zeros(len(lengths), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word of each symbol, symbols)
    low = 0
    for high in (6, 12, 24, WIDEST):
        which = np.flatnonzero((lengths > low) & (lengths <= high))
        for begin in range(0, len(which), 20_000):
            some = which[begin:begin + 20_000]
            place = np.minimum(offsets[some][:, None] + np.arange(high), len(symbols) - 1)
            sym, live = _merge_block(symbols[place], lengths[some], table)
            counts[some] = live.sum(axis=1)
            parts.append((np.repeat(some, counts[some]), sym[live]))
        low = high
    for i in np.flatnonzero(lengths > WIDEST):
        out = _merge_long(symbols[offsets[i]:offsets[i + 1]].tolist(), table)
        counts[i] = len(out)
        parts.append((np.full(len(out), i), np.array(out, np.int64)))
    ends = np.concatenate([[0], np.cumsum(counts)])
    if not parts:
        return np.zeros(0, np.int64), ends
    of = np.concatenate([p[0] for p in parts])
    return np.concatenate([p[1] for p in parts])[np.argsort(of, kind="stable")], ends
