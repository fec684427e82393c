"""Streaming ingest: files arriving in a folder are enriched per micro-batch."""

import os

from pyspark.sql import functions as F

from ledgerlens.operators.enrich import enrich_statement
from ledgerlens.operators.rules import RuleBackend
from ledgerlens.plans.fixtures import statement
from ledgerlens.streaming import monthly_spend_stream, start_statement_stream
from tests.conftest import SF_SMALL


def test_ingest_matches_batch(spark, scratch):
    st = statement(spark, SF_SMALL).cache()
    src = os.path.join(scratch, "in")
    st.where(F.col("s_no") < 3000).write.parquet(os.path.join(src, "a"))
    st.where(F.col("s_no") >= 3000).write.parquet(os.path.join(src, "b"))
    out = os.path.join(scratch, "out")
    q = start_statement_stream(spark, os.path.join(src, "*"), out, checkpoint=os.path.join(scratch, "ck"),
                               max_files_per_trigger=1, query_name="t_ingest")
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(out).drop("source_file", "epoch")
    want = enrich_statement(st, RuleBackend())
    cols = want.columns
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    assert len([d for d in os.listdir(out) if d.startswith("epoch=")]) >= 2


def test_monthly_spend_stream(spark, scratch):
    st = statement(spark, SF_SMALL)
    enriched = enrich_statement(st, RuleBackend())
    src = os.path.join(scratch, "enriched")
    enriched.write.parquet(src)
    stream = spark.readStream.schema(enriched.schema).parquet(src)
    q = (monthly_spend_stream(stream).writeStream.format("memory").queryName("t_monthly")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    rows = spark.sql("SELECT * FROM t_monthly").collect()
    assert rows and all(r["transactions"] > 0 for r in rows)


def test_ingest_with_a_call_backend_matches_batch(spark, scratch):
    from ledgerlens.operators.backends import ScriptedBackend
    from ledgerlens.operators.enrich import ReplyStore
    from ledgerlens.plans.fixtures import CATEGORY_REPLIES, REMARK_REPLIES
    st = statement(spark, SF_SMALL).cache()
    src = os.path.join(scratch, "in")
    st.where(F.col("s_no") < 3000).write.parquet(os.path.join(src, "a"))
    st.where(F.col("s_no") >= 3000).write.parquet(os.path.join(src, "b"))
    out = os.path.join(scratch, "out")
    rb, cb = ScriptedBackend(REMARK_REPLIES), ScriptedBackend(CATEGORY_REPLIES)
    q = start_statement_stream(spark, os.path.join(src, "*"), out, backend=rb, category_backend=cb,
                               checkpoint=os.path.join(scratch, "ck"), max_files_per_trigger=1,
                               query_name="t_ingest_calls")
    q.awaitTermination(300)
    assert q.exception() is None
    want = enrich_statement(st, rb, cb, remark={"store": ReplyStore(spark, os.path.join(scratch, "r1"))},
                            category={"store": ReplyStore(spark, os.path.join(scratch, "r2"))})
    cols = want.columns
    got = spark.read.parquet(out).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_workbooks_arriving_one_by_one(spark, scratch):
    from ledgerlens.schema import REQUIRED_COLUMNS
    from ledgerlens.sources.statement import read_statements
    from ledgerlens.sources.workbook import read_workbooks, stream_workbooks
    from tests.xlsx_fixture import write_xlsx
    src, out, ck = (os.path.join(scratch, d) for d in ("in", "out", "ck"))
    os.makedirs(os.path.join(src, "sub"))

    def book(name, n, extra=()):
        write_xlsx(os.path.join(src, name), REQUIRED_COLUMNS + list(extra),
                   [[i, ("date", 45000 + i), f"UPI/SHOP {i}/petrol/Bank", i + 0.5, None, 9, *extra] for i in range(n)])

    def run():
        q = start_statement_stream(spark, src, out, fmt="xlsx", checkpoint=ck, max_files_per_trigger=1, query_name="t_books")
        q.awaitTermination(200)
        assert q.exception() is None

    book("a.xlsx", 5, ["Branch"])
    book("sub/B.XLSX", 3)
    run()
    assert len([d for d in os.listdir(out) if d.startswith("epoch=")]) == 2
    book("c.xlsx", 4)
    run()  # from the checkpoint: only the new workbook is read
    got = spark.read.parquet(out)
    want = enrich_statement(read_statements(spark, src, "xlsx"), RuleBackend())
    cols = ["s_no", "txn_date_raw", "remarks", "withdrawal", "balance", "category", "cleaned_remark", "Branch", "source_file"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect())) and got.count() == 12
    rows = stream_workbooks(spark, src).writeStream.format("memory").queryName("t_book_rows").trigger(availableNow=True).start()
    rows.awaitTermination(200)
    same = read_workbooks(spark, src)
    assert sorted(map(str, spark.table("t_book_rows").collect())) == sorted(map(str, same.collect()))
