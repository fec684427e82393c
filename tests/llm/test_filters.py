"""Toxicity, quality, URL and licence operators: held-out accuracy and brute force."""

import os
import random
import re
import subprocess
import sys
import zlib
from importlib import metadata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import license_scan, quality, toxicity, url_filter
from ledgerlens.llm.license_texts import TEXTS
from ledgerlens.llm.queries import URL_RULES
from ledgerlens.llm.tables import in_fold
from tests.llm.conftest import ROWS, frame

SF = "/root/testdata/sf0.01"


def accuracy(rows, positive):
    hits = [(r["score"] >= positive) == (r["label"] == 1) for r in rows]
    return sum(hits) / len(hits)


def toxic_rows(n, seed):
    """Mild words with, in every other row, one stem of a few in a form of its own."""
    rng = random.Random(seed)
    mild = ["".join(rng.choices("abcdeilmnorstu", k=rng.randint(2, 8))) for _ in range(400)]
    stems, endings = ["grubnak", "vlosker", "piffzad"], ["", "s", "ed", "ish", "o", "ek", "!", "ling", "ny", "ax"]
    rows = []
    for i in range(n):
        text = rng.choices(mild, k=rng.choice([5, 40, 200]))
        if i % 2:
            text.insert(rng.randrange(len(text)), rng.choice(stems) + rng.choice(endings))
        rows.append((i, " ".join(text), i % 2))
    return rows


def test_toxicity_learns_stems_and_catches_new_forms():
    rows = toxic_rows(800, 1)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], 0.5)
    clean = [t for _, t, y in rows if not y][:100]
    own = toxicity.scores(model, pa.array(clean))
    changed = toxicity.scores(model, pa.array([t + " " + w for t, w in zip(clean, ["grubnakious", "xvlosker", "piffzadded"] * 34)]))
    assert (own < 0.3).mean() > 0.95 and (changed >= 0.3).mean() > 0.9
    assert toxicity.scores(model, pa.array([clean[0]])) == pytest.approx(own[:1])


def plain_toxicity(model, text):
    """The score of one text, letter by letter."""
    def value(word):
        marked = ("<" + word.strip(toxicity.EDGE) + ">").encode()
        grams = []
        for i in range(len(marked)):
            h = 2166136261
            for n, byte in enumerate(marked[i:i + max(toxicity.GRAMS)], 1):
                h = (h ^ byte) * 1099511628211 % 2 ** 64
                if n in toxicity.GRAMS:
                    grams.append((h >> 20) % toxicity.BUCKETS)
        return sum(float(model.table[g]) for g in grams) / max(len(grams), 1)
    values = [value(w) for w in re.split("[\\x20\\x09-\\x0D]+", (text or "").lower()) if w]
    size = min(len(values), toxicity.WINDOW)
    worst = max((sum(values[i:i + size]) / size for i in range(len(values) - size + 1)), default=0.0) if size else 0.0
    return 1 / (1 + np.exp(-(model.scale * worst + model.shift)))


def test_toxicity_scores_against_plain_python(monkeypatch):
    rows = toxic_rows(300, 3)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], 0.5)
    texts = [t for _, t in ROWS] + [t for _, t, _ in rows[:60]] + ["ab", "a", "...", "x é", "Straße ÄÖ", "!a! ?b"]
    want = [plain_toxicity(model, t) for t in texts]
    for limit in (toxicity.WORD_BYTES, 7):
        monkeypatch.setattr(toxicity, "WORD_BYTES", limit)
        assert toxicity.scores(model, pa.array(texts, pa.string())) == pytest.approx(want)
        assert [float(toxicity.scores(model, pa.array([t], pa.string()))[0]) for t in texts[-6:]] == pytest.approx(want[-6:])


def test_labels_that_disagree_teach_nothing_whatever_their_order(spark):
    rows = toxic_rows(200, 5)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(3, "another text with the same id")])
    labels = [(i, y) for i, _, y in rows] + [(i, 1 - y) for i, _, y in rows[:40]] + [(i, y) for i, _, y in rows[60:90]]
    sure = [(i, y) for i, y in labels[40:200]]
    stats = quality.with_statistics(docs)
    models = []
    for some in (labels, labels[::-1], sure):
        table = spark.createDataFrame(some, "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
        models.append((toxicity.fit(docs, table), quality.fit(stats, table)))
    for tox, good in models[1:]:
        assert np.array_equal(tox.table, models[0][0].table) and tox.shift == models[0][0].shift
        assert np.allclose(good.means, models[0][1].means) and np.allclose(good.constants, models[0][1].constants)


def test_memory_of_a_slice_of_distinct_words():
    code = """if True:
        import resource, numpy as np, pyarrow as pa
        from ledgerlens.llm import toxicity
        letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
        data = letters[np.random.default_rng(1).integers(0, 26, 4 << 20)]
        data[8::9] = 32
        texts = pa.array([data.tobytes().decode()[i:i + 4500] for i in range(0, 4 << 20, 4500)])
        model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 1.0, 0.0)
        toxicity.scores(model, texts.slice(0, 1))
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        toxicity.scores(model, texts)
        print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(out.stdout) < 120


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, learn=lambda i: ~in_fold(i, 4, 2))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(in_fold(F.col("doc_id"), 4, 2)).select("score", F.col("toxic").alias("label")).collect()
    toxic, clean = ([r["score"] for r in rows if r["label"] == y] for y in (1, 0))
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.8  # 35 toxic documents to learn from
    assert accuracy(rows, 0.3) > 0.85


def test_scores_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(8)] + [(None, 1, "x"), (1, None, "x"), (77, 1, "x"), (2, 0, "x")],
                                   "doc_id long, toxic int, text string")
    model = toxicity.fit(awkward, labels)
    got = toxicity.score(awkward, model).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in ROWS), key=repr)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1  # nothing to read
    assert toxicity.score(nothing, model).collect() == []
    none = toxicity.fit(nothing, labels.where("doc_id IS NULL"))
    assert all(r["score"] == pytest.approx(0.5) for r in toxicity.score(awkward, none).collect())
    kept = toxicity.drop_toxic(awkward, model, 0.3)
    assert kept.schema.names == awkward.schema.names and kept.count() == sum(r["score"] < 0.3 for r in got)

    labels = labels.withColumnRenamed("toxic", "quality")
    scored = quality.fit_score(awkward, labels).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.fit_score(nothing, labels).collect() == []
    assert all(r["score"] == pytest.approx(0.5) for r in quality.fit_score(awkward, labels.limit(0)).collect())
    stats = quality.with_statistics(awkward)
    kept = quality.drop_poor(awkward, quality.fit(stats, labels), 0.5)
    assert kept.schema.names == awkward.schema.names and kept.count() == sum(r["score"] >= 0.5 for r in scored)


def test_statistics_by_hand():
    text = "Ab ab ab| 12!\nAb $$\nAb $$"
    row = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["zz", text, None, ""]))[1]))
    w = text.split()
    log = lambda x: np.log(x + quality.SMALL)
    assert row["words"] == pytest.approx(np.log1p(len(w))) and row["upper"] == pytest.approx(log(3 / len(text)))
    assert row["digits"] == pytest.approx(log(2 / len(text))) and row["symbols"] == pytest.approx(log(4 / len(text)))
    assert row["marks"] == pytest.approx(log(1 / len(text))) and row["bars"] == pytest.approx(log(1 / len(text)))
    assert row["distinct"] == pytest.approx(log(len(set(w)) / len(w))) and row["most_common"] == pytest.approx(log(3 / len(w)))
    assert row["repeats"] == pytest.approx(log(0)) and row["distinct_lines"] == pytest.approx(log(2 / 3))
    assert row["longest"] == pytest.approx(np.log1p(3)) and row["line_words"] == pytest.approx(np.log1p(len(w) / 3))
    assert row["word_length"] == pytest.approx(np.log1p(sum(map(len, w)) / len(w)))


def test_discriminant_is_that_of_the_two_gaussians(spark):
    rng = np.random.default_rng(0)
    p = len(quality.STATISTICS)
    x = rng.normal(size=(400, p)) @ rng.normal(size=(p, p))
    x[::3] += 1.0
    y = (np.arange(400) % 3 == 0).astype(int)
    stats = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, stats array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).sum() for k, c in enumerate(covs)) / 400
    want = []
    for k in (0, 1):
        c = (1 - quality.SHRINK_POOLED) * covs[k] + quality.SHRINK_POOLED * pooled
        c = (1 - quality.SHRINK_DIAGONAL) * c + quality.SHRINK_DIAGONAL * np.diag(np.diag(c)) + 1e-6 * np.eye(p)
        d = x - x[y == k].mean(axis=0)
        want.append(np.log(((y == k).sum() + 1) / 402) - np.linalg.slogdet(c)[1] / 2 - (d * np.linalg.solve(c, d.T).T).sum(axis=1) / 2)
    assert model.log_odds(x) == pytest.approx(want[1] - want[0], rel=1e-6, abs=1e-6)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = (quality.fit_score(docs, labels, learn=lambda i: ~in_fold(i, 3, 1)).join(labels, "doc_id")
            .where(in_fold(F.col("doc_id"), 3, 1)).select("score", F.col("quality").alias("label")).collect())
    assert accuracy(rows, 0.5) > 0.95


def test_held_out_fold(spark):
    got = spark.range(50).select("id", in_fold(F.col("id"), 4, 2).alias("out")).collect()
    assert [r["out"] for r in got] == [zlib.crc32(str(r["id"]).encode()) % 4 == 2 for r in got]
    assert spark.range(1).select(in_fold(F.lit(None).cast("long"), 4, 2)).first()[0] is False


def brute_urls(pages):
    def judge(url):
        at = (url or "").find("://")
        if at < 0:
            return "", "", None, None
        rest = url[at + 3:]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, what) for what, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, what = max(fits, default=(0, None, None))
        return host, path, rule, what
    judged = [judge(u) for _, u, _ in pages]
    links = {}
    for (host, *_), (_, _, html) in zip(judged, pages):
        found = {"".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(url_filter.LINK, html or "")}
        for target in found:
            if host and target != host:
                links[host, target] = links.get((host, target), 0) + 1
    hosts = sorted({h for h, *_ in judged if h} | {h for pair in links for h in pair})
    at = {h: i for i, h in enumerate(hosts)}
    seed, n = np.zeros((2, len(hosts))), np.zeros(len(hosts))
    for host, _, _, what in judged:
        if host:
            n[at[host]] += 1
            for k, verdict in enumerate(("allow", "block")):
                seed[k, at[host]] += what == verdict
    seed /= np.maximum(n, 1)
    m = np.zeros((len(hosts),) * 2)
    for (a, b), w in links.items():
        m[at[a], at[b]] = w
    out = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    t, d = 0.15 * seed
    for _ in range(20):
        t, d = 0.15 * seed[0] + 0.85 * t @ out, 0.15 * seed[1] + 0.85 * out @ d
    bad = {h for h in hosts if d[at[h]] - t[at[h]] > 0.075 + 1e-9}
    return [(i, h, p, rule, what or ("block" if h in bad else "allow")) for (i, _, _), (h, p, rule, what) in zip(pages, judged)], bad


def test_url_filter_against_brute_force(spark):
    rng = random.Random(4)
    hosts = [f"{a}.{b}" for a in ("a", "b", "www.example", "example", "x.example", "c") for b in ("com", "net", "org")]
    pages = []
    for i in range(120):
        html = "".join(f'<a HREF = "{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts).title()}/p?q">x</a><a href="/local">y</a>' for _ in range(rng.randrange(4)))
        pages.append((i, f"http://{rng.choice(hosts).upper()}/{rng.choice(['en/', 'es/', 'fr/a', 'de', ''])}{rng.choice(['', '?q=://z', '#t/en/'])}", html))
    # A farm whose pages are blocked, and a host that only links to it.
    pages += [(1000 + i, "https://farm.net/es/1", '<a href="https://friend.org/">') for i in range(5)]
    pages += [(2000 + i, f"https://linker.org/{i}", "<a href='http://farm.net/es/'>" if i else None) for i in range(5)]
    pages += [(3000, None, "x"), (3001, "no scheme", "x"), (3002, "http://", None), (None, "ftp://A.com", ""), (3000, None, "x"), (3003, "http://a.com:80/en/x", "")]
    want, bad = brute_urls(pages)
    assert "linker.org" in bad
    df = spark.createDataFrame([(*p, "x", "x", "x") for p in pages], "page_id long, url string, html string, host string, rule string, trust string")
    got = url_filter.filter_urls(df, URL_RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert url_filter.filter_urls(df.limit(0), URL_RULES).collect() == []


@pytest.mark.parametrize("linkers", [1, 2, 20, 2000])
def test_distrust_does_not_shrink_with_the_number_of_linkers(spark, linkers):
    pages = [(0, "https://farm.net/es/1", "")]
    pages += [(1 + i, f"https://l{i}.org/", "<a href='https://farm.net/es/1'>") for i in range(linkers)]
    # An honest host with many links, one of them bad.
    pages += [(10000 + i, f"https://honest.org/{i}", f"<a href='https://{'farm.net' if i == 0 else f'other{i}.org'}/'>") for i in range(50)]
    df = "page_id long, url string, html string"
    got = {r["host"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(pages, df), URL_RULES).collect()}
    assert {got[f"l{i}.org"] for i in range(linkers)} == {"block"} and got["honest.org"] == "allow"
    if linkers == 20:  # every page ten times
        again = url_filter.filter_urls(spark.createDataFrame(pages * 10, df), URL_RULES).collect()
        assert {r["host"]: r["verdict"] for r in again} == got


FILES = [
    ("LICENSE", license_scan.TEMPLATES[4][1]), ("a/b/COPYING", license_scan.TEMPLATES[8][1]), ("a/b/c/x.py", "print()"),
    ("a/y.py", "# only code"), ("a/b/z.py", "# Licensed under CC BY-NC 4.0.\ncode"), ("q/r/LICENCE.txt", "no words of that kind"),
    ("q/r/s.txt", "the driver needs a license to drive a car"), ("top.txt", None), (None, ""), ("u/whole", license_scan.TEMPLATES[0][1]),
    ("u/v/w", "text"), ("u/v/w", "text"), ("two/LICENSE", license_scan.TEMPLATES[4][1]), ("two/LICENSE-APACHE", license_scan.TEMPLATES[0][1]),
    ("two/f", "x"), ("/abs/f", "x"),
]


def test_license_scan(spark):
    df = spark.createDataFrame([(i, p, t, "x", "x", "x") for i, (p, t) in enumerate(FILES)],
                               "doc_id long, path string, text string, license string, dir string, above string")
    got = {r["doc_id"]: (r["license"], r["via"], r["from_path"]) for r in license_scan.licenses(df).collect()}
    assert got == {
        0: ("MIT", "own", "LICENSE"), 1: ("GPL-3.0", "own", "a/b/COPYING"), 2: ("GPL-3.0", "inherited", "a/b/COPYING"),
        3: ("MIT", "inherited", "LICENSE"), 4: ("CC-BY-NC-4.0", "own", "a/b/z.py"), 5: ("MIT", "inherited", "LICENSE"),
        6: ("MIT", "inherited", "LICENSE"), 7: ("MIT", "inherited", "LICENSE"), 8: ("MIT", "inherited", "LICENSE"),
        9: ("Apache-2.0", "own", "u/whole"), 10: ("Apache-2.0", "inherited", "u/whole"), 11: ("Apache-2.0", "inherited", "u/whole"),
        12: ("MIT", "own", "two/LICENSE"), 13: ("Apache-2.0", "own", "two/LICENSE-APACHE"),
        14: ("Apache-2.0", "inherited", "two/LICENSE-APACHE"), 15: ("MIT", "inherited", "LICENSE")}
    assert license_scan.licenses(df.limit(0)).collect() == []


def test_license_scan_finds_every_notice_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    told = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
            "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    want = {r["doc_id"]: told[line] for r in docs.collect() for line in r["text"].split("\n") if line in told}
    got = {r["doc_id"]: r["license"] for r in license_scan.licenses(docs).where("via = 'own'").collect()}
    assert got == want and want


#: Texts of installed packages; none of them is among the templates.
INSTALLED = [("MPL-2.0", "hypothesis", "LICENSE.txt"), ("BSD-2-Clause", "xxhash", "LICENSE"), ("MIT", "pyspark", "LICENSE-jquery.txt"),
             ("BSD-3-Clause", "pyspark", "LICENSE-join.txt"), ("CC0-1.0", "pyspark", "LICENSE-CC0.txt")]
HEADERS = [
    ("MPL-2.0", "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed\n# with this file, get one.\nimport os\n" + "x = some_words(y)\n" * 60),
    ("MIT", "This small tool was written in a week. Released under the MIT License. Its authors take no money for it, whatever you do.\n" + "more prose\n" * 90),
    ("Apache-2.0", "/*\n * (c) 2020 Some Firm. All rights reserved.\n *\n * Licensed under the Apache\n * License, Version 2.0.\n */\n" + "int a = b;\n" * 90),
    ("LGPL-2.1", "rem Licensed under the GNU Lesser General\nrem Public License, version 2.1.\n" + "echo some words\n" * 90),
    ("MIT", "/*\n" + "\n".join(f" * {line}" for line in dict(TEXTS)["MIT"].split("\n")) + "\n */\n" + "int a = other_name(b);\n" * 200),
    ("BSD-2-Clause", "\n".join(f"// {line}" for line in dict(TEXTS)["BSD-2-Clause"].split("\n")) + "\nint a = other_name(b);\n" * 200),
    (None, "released under the license agreement of the firm\n" + "more prose\n" * 90),
    (None, "Wer the license of the driver mit his car wants, must pay\n" + "more prose\n" * 90),
]


def test_license_texts_and_wrapped_headers(spark):
    files = [(name, f"{k}/LICENSE", next(f for f in metadata.files(package) if f.name == file).read_text())
             for k, (name, package, file) in enumerate(INSTALLED)]
    common = "/usr/share/common-licenses/"
    files += [(name, f"c/{file}/text", open(common + file).read()) for name, file in
              (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("LGPL-3.0", "LGPL-3"), ("BSD-3-Clause", "BSD")) if os.path.exists(common + file)]
    files += [(name, f"h/{k}/x.c", text) for k, (name, text) in enumerate(HEADERS)]
    df = spark.createDataFrame([(i, p, t) for i, (_, p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.licenses(df).collect()}
    assert [got[i] for i in range(len(files))] == [name for name, _, _ in files]
    declared = {r["path"] for r in license_scan.scan(df).where("declares").collect()}
    assert declared == {p for _, p, _ in files if not p.startswith("h/")}


def test_license_windows_against_brute_force():
    rng = random.Random(5)
    templates = [("A", "licensed under the a b license"), ("B", "licensed under the b c license"), ("C", "copyright c d d")]
    matcher = license_scan.Matcher(templates)
    for _ in range(300):
        found = rng.choices("licensed under the a b c d license copyright other".split(), k=rng.randint(1, 30))
        want = []
        for i, (name, text) in enumerate(templates):
            size = min(len(text.split()), len(found))
            spans = [found[k:k + size] for k in range(len(found) - size + 1)]
            top = max((matcher.cosines(s).get(i, 0.0) for s in spans if any(license_scan.TELLING.match(w) for w in s)), default=0.0)
            if top >= 0.8:
                want.append((top, name))
        assert sorted(matcher.windows(found, 0.8)) == sorted(want)
