"""Summaries kept file by file against summaries of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import summary
from ledgerlens.operators.incremental import SummaryStore, distinct_remarks, merged, withdrawal_quantile
from ledgerlens.schema import REQUIRED_COLUMNS
from ledgerlens.sources.statement import read_statements

DDL = "`S No.` long, `Transaction Date` string, `Transaction Remarks` string, `Withdrawal Amount(INR)` double, " \
      "`Deposit Amount(INR)` double, `Balance(INR)` double, Category string, Subcategory string"


def rows(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "no date", f"{rng.randint(1, 28):02}/0{rng.randint(1, 9)}/2024"]), rng.choice([None, " ", f"r{rng.randint(0, 50)}"]),
             rng.choice([None, rng.randint(1, 900) + 0.25]), rng.choice([None, 3.5]), None, rng.choice([None, "Fuel", "Food"]),
             rng.choice([None, "", " ", "Petrol"])) for i in range(n)]


def write(spark, path, data, fmt="parquet"):
    df = spark.createDataFrame(data, DDL).coalesce(1)
    (df.write.mode("overwrite").option("header", True) if fmt == "csv" else df.write.mode("overwrite")).format(fmt).save(path)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def holds(spark, store, source, fmt="parquet"):
    """Every summary of the store equals that of all rows read anew."""
    full = read_statements(spark, f"{source}/*", fmt)
    exact = ["category", "subcategory", "transactions", "withdrawals", "deposits", "start", "end"]
    same(store.grouped().select(exact), summary.grouped(full).select(exact))
    same(store.totals(), summary.summary_totals(full))
    same(store.report(), summary.summary_report(full))
    same(store.context(), summary.chat_context(full))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_added_changed_removed_files(spark, scratch, fmt):
    source = f"{scratch}/in"
    for name, seed in (("a", 1), ("b", 2), ("c", 3)):
        write(spark, f"{source}/{name}", rows(seed, 120), fmt)
    store = SummaryStore(spark, f"{scratch}/store", source, fmt)
    assert store.refresh() == {"read": 3, "kept": 0, "removed": 0}
    assert store.refresh() == {"read": 0, "kept": 3, "removed": 0}
    write(spark, f"{source}/b", rows(4, 90), fmt)  # a new file in place of the old one
    write(spark, f"{source}/d", rows(5, 30), fmt)
    assert store.refresh() == {"read": 2, "kept": 2, "removed": 1}
    holds(spark, store, source, fmt)
    again = SummaryStore(spark, f"{scratch}/store", source, fmt)  # another session's view
    again.compact()
    assert again.files().select("generation").distinct().count() == 1
    same(again.grouped().drop("remarks", "amounts"), store.grouped().drop("remarks", "amounts"))
    same(again.totals(), summary.summary_totals(read_statements(spark, f"{source}/*", fmt)))
    assert again.refresh() == {"read": 0, "kept": 4, "removed": 0}


def test_a_file_changed_in_place_is_read_again(spark, scratch):
    import os
    write(spark, f"{scratch}/in/a", rows(1, 50))
    write(spark, f"{scratch}/other", rows(2, 60))
    name = lambda d: next(f"{d}/{f}" for f in os.listdir(d) if f.endswith(".parquet"))
    store = SummaryStore(spark, f"{scratch}/store", f"{scratch}/in")
    store.refresh()
    target = name(f"{scratch}/in/a")
    with open(name(f"{scratch}/other"), "rb") as f, open(target, "wb") as g:
        g.write(f.read())
    crc = f"{os.path.dirname(target)}/.{os.path.basename(target)}.crc"
    with open(f"{scratch}/other/.{os.path.basename(name(f'{scratch}/other'))}.crc", "rb") as f, open(crc, "wb") as g:
        g.write(f.read())
    assert store.refresh() == {"read": 1, "kept": 0, "removed": 0}
    same(store.totals(), summary.summary_totals(read_statements(spark, f"{scratch}/in/*")))


def test_a_lost_refresh_changes_nothing(spark, scratch):
    source = f"{scratch}/in"
    write(spark, f"{source}/a", rows(1, 50))
    store = SummaryStore(spark, f"{scratch}/store", source)
    store.refresh()
    before = sorted(map(str, store.totals().collect()))
    write(spark, f"{source}/b", rows(2, 50))
    lost = SummaryStore(spark, f"{scratch}/store", source, enrich=lambda df: df.withColumn("s_no", F.raise_error(F.lit("lost"))
                                                                                       .cast("bigint")).withColumn("category", F.col("s_no").cast("string")))
    with pytest.raises(Exception, match="lost"):
        lost.refresh()
    assert sorted(map(str, store.totals().collect())) == before
    # State without its listing counts for nothing and is written over.
    store.state().withColumn("transactions", F.lit(999).cast("bigint")).write.mode("overwrite").parquet(f"{scratch}/store/state/generation=2")
    assert sorted(map(str, store.totals().collect())) == before
    assert store.refresh() == {"read": 1, "kept": 1, "removed": 0}
    same(store.totals(), summary.summary_totals(read_statements(spark, f"{source}/*")))


def test_sketches_estimate_over_all_files(spark, scratch):
    source = f"{scratch}/in"
    for seed in range(4):
        write(spark, f"{source}/{seed}", rows(seed, 400))
    store = SummaryStore(spark, f"{scratch}/store", source)
    store.refresh()
    one = merged(store.state())
    got = one.select(distinct_remarks("remarks").alias("n"), withdrawal_quantile("amounts", 0.5).alias("q")).first()
    full = read_statements(spark, f"{source}/*")
    amounts = sorted(r[0] for r in full.select(F.col("withdrawal").cast("double")).where("withdrawal IS NOT NULL").collect())
    assert abs(got["n"] - 51) <= 3  # r0 to r50
    rank = sum(a <= got["q"] for a in amounts) / len(amounts)
    assert abs(rank - 0.5) < 0.03


def test_empty_files_and_folders(spark, scratch):
    import os
    os.makedirs(f"{scratch}/in")
    store = SummaryStore(spark, f"{scratch}/store", f"{scratch}/in")
    assert store.totals().first()["total_transactions"] == 0  # before any refresh
    assert store.refresh() == {"read": 0, "kept": 0, "removed": 0}
    assert store.totals().first()["total_transactions"] == 0
    assert merged(store.state()).select(withdrawal_quantile("amounts", 0.5).alias("q")).first()["q"] is None
    write(spark, f"{scratch}/in/a", [])
    assert store.refresh()["read"] == 1 and store.grouped().count() == 0 and store.refresh()["read"] == 0
    assert set(REQUIRED_COLUMNS) <= set(spark.read.parquet(f"{scratch}/in/a").columns)
    with pytest.raises(ValueError):
        SummaryStore(spark, scratch, scratch, "json")
