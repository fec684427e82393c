"""Fingerprints, exact de-duplication and the n-gram join against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, fingerprints, ngram_join
from ledgerlens.llm.components import components
from ledgerlens.llm.shingles import shingle_sets, word_hashes
from tests.llm.conftest import ROWS, frame


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def sketch(text):
    hashes = {hashlib.md5(" ".join(s).encode()).hexdigest()[:16] for s in shingles(text, 5)}
    return ",".join(sorted(h for h in hashes if h < fingerprints.THRESHOLD) or sorted(hashes)[:1])


def held(a, b):
    a, b = (set(x.split(",")) - {""} for x in (a, b))
    return 1.0 if a == b else len(a & b) / min(len(a), len(b)) if a and b else 0.0


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_fingerprints_against_brute_force(spark, ranges):
    rows = [(i, t) for i, t in ROWS if i is not None] + [(None, "only one without an id")]
    rng = random.Random(ranges)
    rows += [(rng.randrange(-50, 10_000) * 7 + 20, " ".join(rng.choices("abcdefgh", k=rng.randrange(30)))) for _ in range(60)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, held(a, b), held(a, c)))
    got = fingerprints.fingerprints(frame(spark, rows), ranges=ranges).drop("jaccard_edited", "jaccard_next")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_fingerprints_of_few_rows(spark, nothing):
    assert fingerprints.fingerprints(nothing).collect() == []
    one = fingerprints.fingerprints(frame(spark, [(5, "a b c d e f")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 11
    none = fingerprints.fingerprints(frame(spark, [(None, "a"), (None, None), (None, "b b")])).collect()
    assert len(none) == 3


def test_fingerprints_merge_and_contain(spark):
    rng = random.Random(0)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(3000)], k=n)) for n in (4000, 300))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    for c in ("a", "b", "ab"):
        df = fingerprints.with_fingerprint(df, c, "f" + c)
    r = df.select(fingerprints.merge(F.col("fa"), F.col("fb")).alias("m"), "fab", fingerprints.containment(F.col("fb"), F.col("fab")).alias("c"),
                  fingerprints.containment(F.col("fa"), F.col("fb")).alias("d"),
                  fingerprints.resemblance(F.col("fa"), F.col("fab")).alias("j")).first()
    assert r["c"] == 1.0 and r["d"] < 0.05 and 0.85 < r["j"] <= 1.0
    assert len(set(r["fab"].split(",")) - set(r["m"].split(","))) <= 4  # the shingles across the seam


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, awkward, nothing, keep):
    best = {}
    for i, t in ROWS:
        if i is not None:
            best[t or ""] = (min if keep == "smallest" else max)(best.get(t or "", i), i)
    want = [(i, best.get(t or ""), sum((u or "") == (t or "") for _, u in ROWS), best.get(t or "") == i,
             hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS]
    got = exact_dedup.exact_groups(awkward, keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(nothing, keep=keep).collect() == []
    left = exact_dedup.drop_copies(awkward, keep=keep)
    assert left.schema.names == awkward.schema.names
    texts = {}
    for r in left.collect():
        assert (r["text"] or "") not in texts and r["stats"] == "x"
        texts[r["text"] or ""] = r["doc_id"]
    assert texts == {t or "": best.get(t or "") for _, t in ROWS}
    assert exact_dedup.drop_copies(nothing).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(nothing, keep="any")


def test_groups_compare_bytes_not_only_hashes(spark, monkeypatch):
    # All rows share the hash; only the bytes tell them apart.
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "A")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(frame(spark, rows)).collect()) == [1, 2, 4]


def test_word_hashes_follow_the_bytes():
    some = pa.array(["a", "b", "ab", "ba", "", "aa", "ä", "x" * 5000, "x" * 4999 + "y"])
    h = word_hashes(some).tolist()
    assert len(set(h)) == len(h) and word_hashes(some.take(pa.array([8, 2, 0]))).tolist() == [h[8], h[2], h[0]]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets(k):
    texts = [t for _, t in ROWS if t != ROWS[5][1]] + ["a b c a b c a b c", "A  b\nC"]
    hashes, at = shingle_sets(pa.array(texts, pa.string()), k)
    names = {}
    for t, a, b in zip(texts, at, at[1:]):
        assert b - a == len(shingles(t, k))
        for other, c, d in zip(texts, at, at[1:]):
            assert len(set(hashes[a:b]) & set(hashes[c:d])) == len(shingles(t, k) & shingles(other, k))
        names[t] = hashes[a:b].tolist()
        assert names[t] == sorted(names[t])


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and len(a & b) * den >= len(a | b) * num:
                root[find(x)] = find(y)
    out = []
    for x, (i, s) in enumerate(sets):
        ids = [j for y, (j, _) in enumerate(sets) if j is not None and find(y) == find(x)]
        out.append((i, len(s), min(ids) if ids else None))
    return sorted(out, key=repr)


def near_rows(seed):
    """Groups of near copies, chains, passages that many rows share, short rows."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    rows, i = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 30, 80]))
        for _ in range(rng.choice([1, 2, 6, 12])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((i := i + rng.randrange(1, 4), " ".join(text)))
            if rng.random() < 0.3:
                base = text
    for _ in range(25):
        rows.append((i := i + 1, " ".join(passage + rng.choices(vocabulary, k=rng.choice([0, 1, 2, 4, 40])))))
    rows += [(i + 1 + j, " ".join(rng.choices("ab", k=rng.randrange(4)))) for j in range(10)]
    return rows


@pytest.mark.parametrize("seed,k,num,den", [(1, 3, 9, 10), (2, 5, 4, 5), (3, 1, 1, 2), (4, 2, 1, 1)])
def test_join_components_against_brute_force(spark, seed, k, num, den):
    rows = near_rows(seed)
    got = ngram_join.join_components(frame(spark, rows), k, num, den)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, k, num, den)


@pytest.mark.parametrize("seed,k,num,den", [(11, 3, 9, 10), (12, 5, 4, 5), (13, 1, 1, 2), (14, 2, 7, 10)])
def test_differences_from_pivots_find_what_is_left(spark, monkeypatch, seed, k, num, den):
    """With a single pivot round most links are left to the last step."""
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 1)
    rows = near_rows(seed)
    rng = random.Random(seed)
    base = rng.choices([f"v{i}" for i in range(400)], k=60)
    for i in range(40):  # many that lie about the threshold from each other
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(20)] = rng.choice(["x", "y", f"v{rng.randrange(400)}"])
        rows.append((5000 + i, " ".join(text)))
    got = ngram_join.join_components(frame(spark, rows), k, num, den)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, k, num, den)


def test_comparisons_of_a_crowd_stay_far_below_its_square(spark, monkeypatch):
    """Near copies just under the threshold from their text: they share posting lists, but are hardly ever compared."""
    rng, base, made = random.Random(3), [f"b{i}" for i in range(60)], []
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        text = list(base)
        for at in rng.sample(range(0, 60, 4), 2):  # two words replaced, or one replaced and one left out
            text[at] = f"n{i}x{at}" if at % 8 else rng.choice([f"n{i}x{at}", ""])
        rows.append((i, " ".join(w for w in text if w)))
    links = ngram_join.NgramJoin.links

    def counted(self, pairs, sets):
        pairs = ngram_join.stored(pairs, "counted")
        made.append(pairs.count())
        return links(self, pairs, sets)
    monkeypatch.setattr(ngram_join.NgramJoin, "links", counted)
    got = ngram_join.join_components(frame(spark, rows), 3, 9, 10).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 3, 9, 10)
    assert sum(made) < len(rows) ** 2 // 2 / 50  # 9,982 of 1,125,000 pairs: many leave out the same words and truly differ alike


def test_join_components_on_awkward_rows(spark, awkward, nothing):
    got = sorted(map(tuple, ngram_join.join_components(awkward, 3, 9, 10).collect()), key=repr)
    rows = [r for r in ROWS if words(r[1])]
    want = brute_components(rows, 3, 9, 10) + [(i, 0, i) for i, t in ROWS if not words(t)]
    assert got == sorted(want, key=repr)
    assert ngram_join.join_components(nothing, 3, 9, 10).collect() == []
    left = ngram_join.drop_near_copies(awkward, 5, 4, 5)
    assert left.schema.names == awkward.schema.names
    component = {i: c for i, _, c in brute_components(rows, 5, 4, 5)} | {i: i for i, t in ROWS if not words(t)}
    assert sorted((r["doc_id"], r["text"]) for r in left.where("doc_id IS NOT NULL").collect() if r["doc_id"] != 2) == sorted(
        (i, t) for i, t in ROWS if i is not None and i != 2 and component[i] == i)
    assert left.where("doc_id IS NULL").count() == sum(i is None for i, _ in ROWS)
    assert ngram_join.drop_near_copies(nothing, 5, 4, 5).collect() == []


def test_prefixes_of_similar_sets_meet_under_every_order():
    rows = near_rows(5)
    hashes, at = shingle_sets(pa.array([t for _, t in rows]), 2)
    below = ngram_join.counted_below(3, 5)
    df = {}
    for h in hashes.tolist():
        df[h] = df.get(h, 0) + 1
    first = []
    for a, b in zip(at, at[1:]):
        own = sorted(hashes[a:b].tolist(), key=lambda h: (h >= below, df[h] if h < below else 0, h))
        first.append(own[:int(ngram_join.prefix_size(np.array([b - a]), 3, 5)[0])])
    others = [ngram_join.hash_prefixes(hashes, at, 3, 5, order) for order in ngram_join.HASH_ORDERS]
    places, ends, late = ngram_join.first_tokens(hashes, at, 3, 5)
    for x in range(len(rows)):
        posted = hashes[places[ends[x]:ends[x + 1]]].tolist()
        assert set(first[x]) <= set(posted) and all((h >= below) == (k >= 0) for h, k in zip(posted, late[ends[x]:ends[x + 1]]))
        for y in range(x):
            a, b = set(hashes[at[x]:at[x + 1]]), set(hashes[at[y]:at[y + 1]])
            if a and 5 * len(a & b) >= 3 * len(a | b):
                assert set(first[x]) & set(first[y])
                assert all(set(t[e[x]:e[x + 1]]) & set(t[e[y]:e[y + 1]]) for t, e in others)


def test_classes_with_one_name_are_named_anew(spark, monkeypatch):
    plain = ngram_join._digests
    monkeypatch.setattr(ngram_join, "_digests", lambda h, o, salt: [x * (salt > 0) if i == 0 else x for i, x in enumerate(plain(h, o, salt))])
    join = ngram_join.NgramJoin(frame(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, "x y z")]), 3, 9, 10)
    signed, classes = join.classes()
    assert join.salt == 1 and sorted(r["label"] for r in classes.collect()) == [1, 3]


def test_ids_on_several_rows(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text), (5, text.upper()), (5, "quite another text than that one here"), (3, "quite another text than that one here"),
            (8, text + " end"), (8, text + " end"), (9, text + "  END")]
    got = sorted(map(tuple, ngram_join.join_components(frame(spark, rows), 3, 9, 10).collect()))
    assert got == [(3, 5, 3), (5, 5, 3), (5, 38, 5), (5, 38, 5), (8, 39, 5), (8, 39, 5), (9, 39, 5)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 400), (7, 7)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {100 + i: 100 for i in range(40)} | {400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
