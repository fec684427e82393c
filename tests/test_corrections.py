"""Re-sent and corrected rows of a stream, across restarts."""

import datetime as dt
from decimal import Decimal

import pytest

from ledgerlens.streaming.corrections import STATE_PROVIDER, changes_stream, current_rows, use_rocksdb_state

DDL = "source_file string, s_no long, remarks string, withdrawal decimal(18,2), sent timestamp, `a.b` string"


def at(day):
    return dt.datetime(2024, 5, day)


@pytest.fixture()
def rocksdb(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = {n: spark.conf.get(n) for n in names}
    use_rocksdb_state(spark)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_corrected_rows_replace_the_first_version_once(rocksdb, scratch):
    spark, source, out = rocksdb, f"{scratch}/in", f"{scratch}/out"

    def send(rows):
        rows = [(*r[:3], r[3] and Decimal(r[3]), *r[4:]) for r in rows]
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = (changes_stream(spark.readStream.schema(DDL).parquet(source), "sent").writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
        ended = q.awaitTermination(60)
        q.stop()
        assert ended and q.exception() is None

    def seen():
        return sorted((r["s_no"] or 0, r["source_file"] or "", r["remarks"], r["version"] or 0, r["change"]) for r in spark.read.parquet(out).collect())

    first = [("f", 1, "a", 1, at(1), "x"), ("f", 2, "b", 2, at(1), None), (None, 1, "n", None, at(1), "x"), ("f", None, "cash", 5, at(1), None)]
    send(first)
    run()
    want = [(0, "f", "cash", 0, "unkeyed"), (1, "", "n", 1, "new"), (1, "f", "a", 1, "new"), (2, "f", "b", 1, "new")]
    assert seen() == want
    # Sent again, one row corrected twice in one file, one stale, one without a number: the query restarts from its checkpoint.
    send([("f", 1, "a", 1, at(2), "x"), ("f", 2, "c", 2, at(2), None), ("f", 2, "d", 2, at(3), None), ("f", 1, "old", 1, dt.datetime(2023, 1, 1), "x"),
          ("f", None, "cash", 5, at(2), None), ("g", 1, "a", 1, None, "x")])
    run()
    want += [(0, "f", "cash", 0, "unkeyed"), (1, "g", "a", 1, "new"), (2, "f", "c", 2, "corrected"), (2, "f", "d", 3, "corrected")]
    assert seen() == sorted(want)
    run()  # nothing new
    assert seen() == sorted(want)
    now = current_rows(spark.read.parquet(out), "sent")
    assert now.columns == ["source_file", "s_no", "remarks", "withdrawal", "sent", "a.b"]
    assert sorted((r["source_file"] or "", r["s_no"] or 0, r["remarks"]) for r in now.collect()) == [
        ("", 1, "n"), ("f", 0, "cash"), ("f", 0, "cash"), ("f", 1, "a"), ("f", 2, "d"), ("g", 1, "a")]


def test_needs_the_state_store(spark, scratch):
    spark.createDataFrame([], DDL).write.parquet(f"{scratch}/in")
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_PROVIDER:
        with pytest.raises(RuntimeError):
            changes_stream(spark.readStream.schema(DDL).parquet(f"{scratch}/in"), "sent")
