"""Merkle manifest against a plain walk over the whole table."""

import hashlib
import random
import zlib

import pytest

from ledgerlens.llm import merkle
from tests.llm.conftest import ROWS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            begin = i // 16 * 16
            yield level[begin:i], level[i + 1:begin + 16]
            i //= 16

    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((sha("".join(map(written, row))), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    built = {s: up([h for h, _ in trees[s]]) for s in order}
    upper = up([built[s][-1][0] for s in order])
    root = upper[-1][0] if order else None
    out = []
    for k, s in enumerate(order):
        for i, (leaf, row) in enumerate(trees[s]):
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                node = sha("".join(map(written, (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))))
            path = [*way(built[s], i), *way(upper, k)]
            for left, right in path:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in path))
            out.append((row[0], leaf, built[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def frame(spark, rows, slices=5):
    """The rows with further columns, named like those that the operator makes."""
    names = ["tree", "place", "size", "part", "local", "digest", "row", "root", "id", "block"]
    schema = "doc_id long, source string, lang string, n_chars int, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema).repartition(slices)


def made(seed, sizes):
    rng = random.Random(seed)
    rows = [(i, s, rng.choice(["en", "de", None]), rng.choice([None, i]), rng.choice(["Some Text é", "plain", "", None, f"Text {i}"]))
            for s, n in sizes.items() for i in rng.sample(range(10 * n + 10), n)]
    rng.shuffle(rows)
    return rows


def got(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("levels, sizes", [
    (3, {"a": 1, "b": 16, "c": 17, None: 40, "é": 256, "z": 257}),
    (1, {"a": 700, "b": 1, None: 17}),  # three tiers of superblocks
    (1, {f"s{i:03}": 1 + i % 3 for i in range(300)}),  # an upper tree of several tiers
    (2, {"only": 5000}),
])
def test_manifest_against_brute_force(spark, levels, sizes):
    rows = made(levels, sizes)
    want = brute(rows)
    assert got(merkle.manifest(frame(spark, rows), most=levels)) == want
    assert {r[-1] for r in want} <= {True, False}


def test_production_superblocks_over_several_tiers(spark):
    rows = made(9, {"big": 9000, "small": 5})
    assert got(merkle.manifest(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rows = [(i, s, "en", 3, t) for s, (i, t) in zip([None, "a", "", "B", "a"] * 10, ROWS)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "a", "en", 1, "Same Row")] * 40 + [(7, "a", "en", 1, f"Other {i}") for i in range(20)]
    assert got(merkle.manifest(frame(spark, rows))) == brute(rows)
    assert merkle.manifest(frame(spark, [])).collect() == []
    assert got(merkle.manifest(frame(spark, [(5, None, None, None, None)]))) == brute([(5, None, None, None, None)])


def test_tampering_shows_in_exactly_the_changed_rows(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(100)]
    broken = {r[0] for r in got(merkle.manifest(frame(spark, rows))) if not r[-1]}
    assert broken == {i for i in range(1, 100, 2) if zlib.crc32(str(i).encode()) % 5 == 0} and broken
