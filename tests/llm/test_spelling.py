"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import spelling_variants as sv
from tests.llm.conftest import ROWS, frame


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    near = {w: set() for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def corpus(seed, words=60, docs=300):
    """Misspelt words: chains of edits, frequent and rare, accented letters and both multiplication signs of the range."""
    rng = random.Random(seed)
    letters = "abcdeéßØ×÷"
    base = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(words)]
    for w in base[:]:
        for _ in range(3):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
            base.append(w or "a")
    weights = [2.0 ** -(i % 7) for i in range(len(base))]
    return [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, weights, k=40))) for i in range(docs)]


@pytest.mark.parametrize("seed, crowd, root", [(1, 64, 7), (2, 1, 7), (3, 3, 40)])
def test_variants_against_brute_force(spark, monkeypatch, seed, crowd, root):
    monkeypatch.setattr(sv, "CROWD", crowd)  # 1: every reduced word of two words goes on to more symbols
    monkeypatch.setattr(sv, "ROOT", root)
    rows = corpus(seed)
    want = brute(rows)
    got = sv.spelling_variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_awkward_rows(spark, awkward, nothing):
    got = sorted(map(tuple, sv.spelling_variants(awkward).collect()))
    assert got == brute(ROWS) and got
    assert sv.spelling_variants(nothing).collect() == []
    assert sv.spelling_variants(frame(spark, [(1, None), (2, "")])).collect() == []


def test_runs_lose_a_letter(spark):
    rows = [(i, "Straße ÀÉ×÷ naïve x") for i in range(400)]
    got = Counter(r["word"] for r in sv.occurrences(frame(spark, rows)).collect())
    want = Counter()
    for i, _ in rows:
        for run in ("straße", "ÀÉ×÷", "naïve", "x"):
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    assert got == want and len(want) > 6


def test_neighbourhoods_are_whole_and_without_repeats(spark):
    words = ["aabbc", "aaaaa", "abcde", "zzzzzz", "éßéßé", "aabb", "ab"]
    for symbols in (4, 6, 90):
        table = spark.createDataFrame([(w,) for w in words], "word string")
        keys = table.select("word", sv.reduced(table["word"], symbols).alias("r"))
        reduced = {r["word"]: r["r"] for r in keys.collect()}
        alphabet = [sv._symbol(i) for i in range(symbols)]
        want = set()
        for w, r in reduced.items():
            strings = {r} | {r[:i] + r[i + 1:] for i in range(len(r))} | {r[:i] + s + r[i + 1:] for i in range(len(r)) for s in alphabet}
            want |= {(w, s) for s in strings if (len(s), s) <= (len(r), r)}
        hashed = spark.createDataFrame(sorted(want), "word string, s string").selectExpr("word", "xxhash64(s) AS key")
        got = [tuple(r) for r in sv.neighbourhoods(table, symbols).collect()]
        assert sorted(got) == sorted(tuple(r) for r in hashed.collect())


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(21)] + [("a", "b")]
    got = dict(map(tuple, sv.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {f"w{i:02}": "w21" for i in range(21)} | {"a": "b"}


def test_symbols_grow_with_the_vocabulary():
    assert [sv.symbols_for(n) for n in (0, 10, 4 ** 7, 4 ** 7 + 1, 300_000, 10 ** 8)] == [4, 4, 4, 5, 7, 14]
