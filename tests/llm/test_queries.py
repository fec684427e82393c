"""Registered queries against DuckDB, and the pipeline stage by stage against brute force."""

import os

import duckdb
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import quality, queries, toxicity
from ledgerlens.llm.tables import in_fold
from tests.conftest import SF_SMALL
from tests.llm.conftest import ROWS, frame
from tests.llm.test_copies import brute_components, words


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    return c


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    got = queries.QUERIES[name](spark, SF_SMALL)
    want = con.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_judge_every_document(spark, name):
    got = queries.QUERIES[name](spark, SF_SMALL)
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect()}
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == ids
    if "held_out" in got.columns:
        assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(ids)


def check_stages(spark, docs, sf_dir, scratch):
    """Run the stages; hold each one's rows against those it should keep of its own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tox = toxicity.fit(docs, labels, learn=lambda i: ~in_fold(i, 4, 2))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.schema.names == docs.schema.names
        out.write.parquet(f"{scratch}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{scratch}/{name}")
        if name == "packing":
            return before, docs.collect(), left
        got = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
        texts = pa.array([t for _, t in before], pa.string())
        if name == "toxicity":
            want = [r for r, s in zip(before, toxicity.scores(tox, texts)) if s < 0.3]
        elif name == "quality":
            stats = spark.createDataFrame([(i, x.tolist()) for (i, _), x in zip(before, quality.statistics(texts))],
                                          "doc_id long, stats array<double>")
            model = quality.fit(stats, labels, learn=lambda i: ~in_fold(i, 3, 1))
            want = [r for r, s in zip(before, model.scores(quality.statistics(texts))) if s >= 0.5]
        elif name == "exact_dedup":
            first = {}
            for i, t in before:
                if i is not None:
                    first[t or ""] = min(first.get(t or "", i), i)
            assert len({t or "" for _, t in got}) == len(got) == len({t or "" for _, t in before})
            want = [r for r in got if first.get(r[1] or "") == r[0]]
        else:
            component = {i: c for i, _, c in brute_components([r for r in before if words(r[1])], 5, 4, 5)}
            want = [r for r in before if r[0] is None or component.get(r[0], r[0]) == r[0]]
        assert got == sorted(want, key=repr), name
        left[name] = len(got)


def test_pipeline_stages(spark, scratch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept, pieces, left = check_stages(spark, docs, SF_SMALL, scratch)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept}
    assert {i: sum(p["length"] for p in pieces if p["doc_id"] == i) for i in want} == want
    assert 0 < left["ngram_jaccard"] <= left["exact_dedup"] <= left["quality"] <= left["toxicity"]
    whole = corpus_pipeline.run(spark, SF_SMALL)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, pieces))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_on_awkward_tables(spark, scratch, rows):
    names = {"doc_id": "long", "quality": "int", "toxic": "int"}
    spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(None, 0, None)], ", ".join(f"{n} {t}" for n, t in names.items())).write.parquet(f"{scratch}/labels.parquet")
    frame(spark, rows).write.parquet(f"{scratch}/documents.parquet")
    check_stages(spark, spark.read.parquet(f"{scratch}/documents.parquet"), scratch, f"{scratch}/out")
    assert corpus_pipeline.run(spark, scratch).columns[0] == "doc_id"
