"""Vectorised pre-tokenisation of byte-pair tokenizers, without regular
expressions.

Each code point gets a class from a table; a small automaton resolves what
depends on the text before (whether an apostrophe begins a token, and how many
letters of a contraction are still to come). Its transition functions, one
byte each, are composed with an associative scan: blocks are composed column
by column for all blocks at once, then the block totals are scanned the same
way. Token starts follow from the classes and the states.

Two patterns are covered:

* ``attach`` true: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
  ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` (white space is kept; one space
  joins the token after it);
* ``attach`` false: ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|
  [^\\s\\p{L}\\p{N}]+`` (white space is dropped; every number stands alone).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from ledgerlens.llm.arrow import buffers

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Characters given to a library at a time.
PROBED = 4096

# States: an apostrophe here begins a token; is absorbed; one, two letters of a contraction to come.
FREE, HELD, ONE, TWO = range(4)


def _matched_by_tiktoken(pattern: str, everything: str) -> str:
    """The characters that the pattern matches in ``tiktoken``, which drops what no match covers."""
    import tiktoken
    plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(plain.encode_ordinary(everything)).decode()


def _matched_by_tokenizers(pattern: str, everything: str) -> str:
    """The characters that the pattern matches in ``tokenizers``."""
    from tokenizers import Regex, pre_tokenizers
    split = pre_tokenizers.Split(Regex(pattern + "+"), "removed", invert=True)
    return "".join(piece for i in range(0, len(everything), PROBED) for piece, _ in split.pre_tokenize_str(everything[i:i + PROBED]))


@functools.cache
def class_table(attach: bool) -> np.ndarray:
    """Class of every code point: letter, number, white space or the rest, as the library itself reads the pattern
    (``tiktoken`` for ``attach``, else ``tokenizers``): each has Unicode tables of its own version."""
    everything = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    matched = _matched_by_tiktoken if attach else _matched_by_tokenizers
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        table[np.frombuffer(matched(pattern, everything).encode("utf-32-le"), np.uint32)] = kind
    return table


def _pack(*targets: int) -> int:
    """The function that sends state i to targets[i], two bits each."""
    return sum(t << 2 * i for i, t in enumerate(targets))


IDENTITY = _pack(FREE, HELD, ONE, TWO)
RESET = _pack(FREE, FREE, FREE, FREE)


@functools.cache
def _compose_table() -> np.ndarray:
    """then[f << 8 | g] = first f, then g."""
    f, g = np.meshgrid(np.arange(256, dtype=np.uint16), np.arange(256, dtype=np.uint16), indexing="ij")
    out = np.zeros((256, 256), np.uint16)
    for state in range(4):
        middle = f >> 2 * state & 3
        out |= (g >> 2 * middle & 3) << 2 * state
    return out.astype(np.uint8).ravel()


def prefix_functions(steps: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive scan of function composition over ``steps``."""
    then = _compose_table()
    n = len(steps)
    if n <= block:
        out, so_far = np.empty(n, np.uint8), IDENTITY
        for i in range(n):
            so_far = int(then[so_far << 8 | int(steps[i])])
            out[i] = so_far
        return out
    rows = -(-n // block)
    grid = np.full(rows * block, IDENTITY, np.uint8)
    grid[:n] = steps
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for i in range(1, block):
        grid[i] = then[grid[i - 1].astype(np.uint16) << 8 | grid[i]]
    before = np.concatenate([[np.uint8(IDENTITY)], prefix_functions(grid[-1], block)[:-1]]).astype(np.uint16) << 8
    return then[before | grid].T.ravel()[:n]


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offset of each text in them, UTF-8 offset of each code point and the end)."""
    offsets, data = buffers(strings)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])
    return points, np.searchsorted(at, offsets), at


def token_starts(points: np.ndarray, texts: np.ndarray, attach: bool) -> tuple[np.ndarray, np.ndarray]:
    """(whether a token starts at each code point, the classes). ``texts``:
    offsets of the texts, each of which is split by itself."""
    n = len(points)
    kind = class_table(attach)[points]
    if not n:
        return np.zeros(0, bool), kind
    first = np.zeros(n, bool)
    first[texts[:-1][texts[:-1] < n]] = True  # an empty text marks the next one, which starts there too

    def ahead(k: int) -> np.ndarray:
        """The code point k on in the same text, else 0."""
        out = np.zeros(n, points.dtype)
        out[:n - k] = points[k:]
        for j in range(1, k + 1):
            out[:n - j][first[j:]] = 0
        out[n - k:] = 0
        return out

    # Contractions that could begin at each apostrophe, by what follows.
    quotes = np.flatnonzero(points == ord("'"))
    one, two = ahead(1)[quotes], ahead(2)[quotes]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))

    step = np.full(n, RESET, np.uint8)
    step[kind == OTHER] = _pack(HELD, HELD, HELD, HELD)
    step[kind == LETTER] = _pack(FREE, FREE, FREE, ONE)
    if attach:
        step[points == 0x20] = _pack(HELD, HELD, HELD, HELD)
    step[quotes[short]] = _pack(ONE, HELD, ONE, ONE)
    step[quotes[long]] = _pack(TWO, HELD, TWO, TWO)
    # The state before a text is FREE: its first step ignores what came before.
    step[first] = (step[first] & 3) * 0b01010101
    after = prefix_functions(step) & 3
    before = np.concatenate([[FREE], after[:-1]])
    before[first] = FREE

    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= first
    if not attach:
        start |= kind == NUMBER
    inside = (before == ONE) | (before == TWO)
    start &= ~inside
    start[1:] |= (before[:-1] == ONE) & ~first[1:]  # what follows a contraction's last letter
    if attach:
        space = kind == SPACE
        last = np.zeros(n, bool)  # last of a run of white space that something follows in the same text
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        start |= last
        start[1:] &= ~(last[:-1] & (points[:-1] == 0x20))
    return start, kind


def tokens(strings: pa.Array, attach: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct slices, index of each slice, offsets of the texts in it)."""
    points, texts, at = code_points(strings)
    start, kind = token_starts(points, texts, attach)
    begins = np.flatnonzero(start)
    where = at[begins]
    keep = None if attach else kind[begins] != SPACE
    counts = np.searchsorted(begins, texts)
    _, data = buffers(strings)
    offsets = np.append(where, at[-1]).astype(np.int32)
    made = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))
    if keep is not None:
        made = made.filter(pa.array(keep))
        counts = np.concatenate([[0], np.cumsum(keep)])[counts]
    coded = made.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts
