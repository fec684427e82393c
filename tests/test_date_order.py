"""Day and month order by the votes of each file."""

import datetime as dt

import pytest

from ledgerlens.functions.dates import with_statement_date, with_statement_date_by_file
from ledgerlens.sources import read_statements

D = dt.date
CASES = {  # file: [(raw, date)]
    "day": [("01/02/2024", D(2024, 2, 1)), ("13/02/2024", D(2024, 2, 13)), ("5-6-24", D(2024, 6, 5)), ("2024-03-04", D(2024, 3, 4))],
    "month": [("01/02/2024", D(2024, 1, 2)), ("02/13/2024", D(2024, 2, 13)), ("1.2.2024 10:30", D(2024, 1, 2)), ("5/6/24", D(2024, 5, 6)),
              ("2024-03-04", D(2024, 3, 4)), ("03 Apr 2024", D(2024, 4, 3)), ("02/30/2024", None), ("not a date", None), (None, None)],
    "tie": [("13/02/2024", D(2024, 2, 13)), ("02/13/2024", D(2024, 2, 13)), ("01/02/2024", D(2024, 2, 1))],
    "mixed": [("02/13/2024", D(2024, 2, 13)), ("02/14/2024", D(2024, 2, 14)), ("31/01/2024", D(2024, 1, 31)), ("01/02/2024", D(2024, 1, 2))],
    "silent": [("01/02/2024", D(2024, 2, 1)), ("05/05/2024", D(2024, 5, 5))],
    None: [("02/13/2024", D(2024, 2, 13)), ("01/02/2024", D(2024, 2, 1))],
}


@pytest.mark.parametrize("split_rows", [None, 1])
def test_files_vote(spark, split_rows):
    rows = [(i, f, raw, "x") for i, (f, raw, _) in enumerate((f, raw, d) for f, cases in CASES.items() for raw, d in cases)]
    want = [d for cases in CASES.values() for _, d in cases]
    df = spark.createDataFrame(rows, "i int, source_file string, txn_date_raw string, n string").repartition(3)
    got = with_statement_date_by_file(df, split_rows=split_rows)
    assert got.columns == [*df.columns, "txn_date"]
    assert [r["txn_date"] for r in got.orderBy("i").collect()] == want
    assert with_statement_date_by_file(df.limit(0)).collect() == []


def test_no_window_and_no_sort_of_files(spark):
    df = spark.createDataFrame([("f", "01/02/2024")], "source_file string, txn_date_raw string")
    plan = with_statement_date_by_file(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_day_first_files_read_as_by_the_value_reader(spark):
    df = spark.createDataFrame([("f", r) for r in ("01/02/2024", "31/12/2023", "1-Jan-24", "2024/02/03 10:00", "x")], "source_file string, txn_date_raw string")
    key = lambda rows: sorted((r["txn_date_raw"], str(r["txn_date"])) for r in rows)
    assert key(with_statement_date_by_file(df).collect()) == key(with_statement_date(df).collect())


def test_month_first_exports_are_read_by_option(spark, scratch):
    head = "S No.,Transaction Date,Transaction Remarks,Withdrawal Amount(INR),Deposit Amount(INR),Balance(INR)\n"
    for name, dates in (("us", ["01/02/2024", "01/25/2024"]), ("in", ["01/02/2024", "25/01/2024"])):
        with open(f"{scratch}/{name}.csv", "w") as f:
            f.write(head + "".join(f"{i},{d},x,1,,1\n" for i, d in enumerate(dates)))
    rows = read_statements(spark, [f"{scratch}/us.csv", f"{scratch}/in.csv"], "csv", date_order="by_file").collect()
    assert sorted((r["source_file"].rsplit("/", 1)[1], r["s_no"], r["txn_date"]) for r in rows) == [
        ("in.csv", 0, D(2024, 2, 1)), ("in.csv", 1, D(2024, 1, 25)), ("us.csv", 0, D(2024, 1, 2)), ("us.csv", 1, D(2024, 1, 25))]
    with pytest.raises(ValueError):
        read_statements(spark, f"{scratch}/us.csv", "csv", date_order="guess")
