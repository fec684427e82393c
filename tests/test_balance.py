"""Running totals and balance checks over ranges of rows, against plain Python."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.balance import balance_breaks, running_sum

DDL = "source_file string, s_no long, balance decimal(18,2), withdrawal decimal(18,2), deposit decimal(18,2), _by string, n int"


def statement(seed):
    rng, rows = random.Random(seed), []
    for f, n in (("hot", 400), ("a", 60), ("b", 1), (None, 30), ("c", 90), ("bare", 5)):
        total = Decimal(rng.randrange(1000))
        for i in range(n):
            out, into = (Decimal(rng.randrange(10000)) / 100 if rng.random() < 0.6 else None for _ in "oi")
            total += (into or 0) - (out or 0)
            if f != "c" and rng.random() < 0.01:
                total += 1
            rows.append((f, None if i == 0 and f == "a" else i, None if f == "bare" or rng.random() < 0.2 else total, out, into, "x", i))
    return rows


def brute(rows):
    files = {}
    for r in rows:
        files.setdefault(r[0], []).append(r)
    for f, rs in files.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        known, breaks, checked = None, [], 0
        for _, i, balance, out, into, *_ in rs:
            known = None if known is None else known + (into or 0) - (out or 0)
            if balance is not None:
                checked += 1
                if known is not None and known != balance:
                    breaks.append(i)
                known = balance
        yield f, len(rs), checked, len(breaks), breaks[0] if breaks else None


@pytest.mark.parametrize("seed", range(3))
def test_breaks_against_plain_python(spark, seed):
    rows = statement(seed)
    df = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), DDL)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that files lie in several ranges
    try:
        got = balance_breaks(df)
        assert got.columns == ["source_file", "transactions", "checked", "breaks", "first_broken"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
        sums = running_sum(df, "source_file", ["s_no"], F.col("deposit"), "so_far")
        assert sums.columns == [*df.columns, "so_far"]
        found = {(r["source_file"], r["s_no"]): r["so_far"] for r in sums.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    totals = {}
    for f, i, _, _, into, *_ in rows:
        totals[f] = totals.get(f, 0) + (into or 0)
        assert found.pop((f, i)) == totals[f]
    assert not found


def test_empty_and_one_block(spark):
    df = spark.createDataFrame(statement(5), DDL)
    assert balance_breaks(df.limit(0)).collect() == []
    assert running_sum(df.limit(0), "source_file", ["s_no"], F.col("deposit"), "so_far").collect() == []
    assert sorted(map(tuple, balance_breaks(df.coalesce(1)).collect()), key=str) == sorted(brute(statement(5)), key=str)


def test_no_window_over_a_whole_file(spark):
    """Rows are dealt by (range, file) before any window reads them."""
    df = spark.createDataFrame(statement(1), DDL)
    plan = balance_breaks(df)._jdf.queryExecution().optimizedPlan().toString()
    rows_windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert rows_windows and all("_block" in line for line in rows_windows)
