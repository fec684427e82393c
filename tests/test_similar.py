"""Similar keys against brute force, hot keys and long groups."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(keys, edits, least=0):
    label = {k: k for k in keys}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k
    for a, b in itertools.combinations([k for k in keys if len(k) >= least], 2):
        if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    return {k: find(k) for k in keys}


def words(seed, n=120):
    rng = random.Random(seed)
    out = {"", "a", "ab", "éàüößx", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc"}
    while len(out) < n:
        w = "".join(rng.choices("abcé", k=rng.randint(4, 9)))
        out.add(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abx") + w[i:], w[:i] + rng.choice("abx") + w[i + 1:]])
            out.add(w)
    return sorted(out)


@pytest.mark.parametrize("edits, seed", [(1, 1), (1, 2), (2, 3), (2, 4), (2, 5)])
def test_groups_against_brute_force(spark, edits, seed):
    keys = words(seed, 120 if edits == 1 else 60)
    rows = [(i, k) for i, k in enumerate(keys * 2)] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, remark_key string")
    got = similar.similar_groups(df, edits=edits, least_length=4, split_rows=1)
    assert got.columns == ["i", "remark_key", "remark_group"]
    want = brute(keys, edits, least=4)
    assert {(r["i"], r["remark_group"]) for r in got.collect()} == {(i, want.get(k)) for i, k in rows}


@pytest.mark.parametrize("split_rows", [0, 3, 10 ** 6])
def test_links_by_halves_join_what_is_one_edit_apart(spark, split_rows):
    # Halves that more keys share than split_rows are dealt by half and rest; the empty key and single letters have halves too.
    rng = random.Random(8)
    keys = sorted({"", "a", "b", "ab"} | {"shop name " + "".join(rng.choices("01", k=6)) for _ in range(40)} | set(words(9, 60)))
    links = [tuple(r) for r in similar.similar_links(spark.createDataFrame([(k,) for k in keys], "key string"), 1, split_rows).collect()]
    assert len(links) == len(set(links)) and all(distance(a, b) == 1 for a, b in links)
    label = {k: k for k in keys}
    for _ in keys:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert label == brute(keys, 1)


def test_a_key_is_dealt_four_times_whatever_its_length(spark):
    keys = spark.createDataFrame([("k" * n + "x",) for n in (5, 50, 500)], "key string")
    assert {r["n"] for r in similar._halves(keys).groupBy("key").agg(F.count("half").alias("n")).collect()} == {4}


def test_groups_of_links_in_rounds(spark):
    rng = random.Random(10)
    keys = [f"k{i:03d}" for i in range(150)]
    links = [(keys[i], keys[i + 1]) for i in range(99)] + [tuple(rng.sample(keys[100:], 2)) for _ in range(40)]
    got = {r["key"]: r["label"] for r in similar.groups(spark.createDataFrame(links, "a string, b string")).collect()}
    label = {k: k for pair in links for k in pair}
    for _ in keys:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert similar.groups(spark.createDataFrame([], "a string, b string")).collect() == []


@pytest.mark.parametrize("edits", [1, 2])
def test_every_link_is_a_pair_and_a_crowd_costs_its_size(spark, edits):
    rng = random.Random(6)
    crowd = {"shop name " + "".join(rng.choices("0123456789", k=2)) for _ in range(90)}  # all share what is left of them
    keys = sorted(crowd) + words(7, 40)
    links = similar.similar_links(spark.createDataFrame([(k,) for k in keys], "key string"), edits)
    pairs = [tuple(r) for r in links.collect()]
    assert all(distance(a, b) <= edits for a, b in pairs)
    assert len(pairs) < 30 * len(keys)
    if edits == 2:
        assert len({a for a, b in pairs if a in crowd} | {b for a, b in pairs if b in crowd}) == len(crowd)


def test_one_reading_for_similar_rows(spark):
    rows = [(1, "acme stores", "Payment to ACME"), (2, "acme stores", "Payment to ACME"), (3, "acme stor", "x"), (4, "acme store", "Payment to A"),
            (5, "other", "y"), (6, None, "z"), (7, "acme store", "")]
    df = spark.createDataFrame(rows, "i int, remark_key string, cleaned_remark string")
    got = {r["i"]: (r["remark_group"], r["consensus_remark"]) for r in similar.similar_consensus(df).collect()}
    assert got == {i: ("acme stor", "Payment to ACME") for i in (1, 2, 3, 4, 7)} | {5: ("other", "y"), 6: (None, "z")}
    empty = spark.createDataFrame([], df.schema)
    assert similar.similar_consensus(empty).collect() == []


def test_long_chains_end_in_one_group(spark):
    chain = ["a" * i + "b" * (40 - i) for i in range(41)]
    df = spark.createDataFrame([(k,) for k in chain], "remark_key string")
    assert {r["remark_group"] for r in similar.similar_groups(df).collect()} == {min(chain)}
    with pytest.raises(ValueError):
        similar.similar_links(df.withColumnRenamed("remark_key", "key"), 3)
