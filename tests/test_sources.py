"""Ingest (validation, pass-through, typing), workbook source and CSV sink."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.schema import REQUIRED_COLUMNS, MissingColumnsError, extras_notice, find_col
from ledgerlens.sources import default_output_path, normalize_statement, read_statements, write_csv
from tests.xlsx_fixture import write_xlsx

HEADER = REQUIRED_COLUMNS


def test_missing_columns_listed_in_order(spark):
    df = spark.createDataFrame([(1, "x")], "`S No.` bigint, `Balance(INR)` string")
    with pytest.raises(MissingColumnsError) as e:
        normalize_statement(df)
    assert e.value.missing == ["Transaction Date", "Transaction Remarks",
                               "Withdrawal Amount(INR)", "Deposit Amount(INR)"]


def test_extras_pass_through_and_typing(spark):
    cols = HEADER + ["Branch", "Ref"]
    df = spark.createDataFrame(
        [(1.0, "01/02/2024", "UPI/A/milk", 10.5, float("nan"), 100.0, "X", "r1"),
         (2.0, None, None, None, 20.0, None, None, None)],
        ", ".join(f"`{c}` {'double' if 'INR' in c or c == 'S No.' else 'string'}" for c in cols))
    st, extras = normalize_statement(df)
    assert extras == ["Branch", "Ref"]
    assert st.columns == ["s_no", "txn_date_raw", "remarks", "withdrawal", "deposit", "balance", "Branch", "Ref",
                          "amount_unparseable"]
    rows = st.orderBy("s_no").collect()
    assert rows[0]["deposit"] is None  # NaN -> NULL
    assert str(rows[0]["withdrawal"]) == "10.50" and rows[1]["s_no"] == 2


def test_extras_notice():
    assert extras_notice([]) is None
    note = extras_notice([f"c{i}" for i in range(7)])
    assert note.endswith("c0, c1, c2, c3, c4...") and " 7 column" in note


def test_find_col_first_and_last():
    cols = ["Category", "x", "category"]
    assert find_col(cols, "category", "last") == "category"
    assert find_col(cols, "CATEGORY", "first") == "Category"
    assert find_col(cols, "subcategory") is None


def test_missing_file(spark, scratch):
    with pytest.raises(FileNotFoundError):
        read_statements(spark, os.path.join(scratch, "nope.parquet"))


def test_workbooks(spark, scratch):
    a = os.path.join(scratch, "jan.xlsx")
    b = os.path.join(scratch, "feb.XLSX")
    write_xlsx(a, HEADER + ["Branch"], [
        [1, ("date", 45322), "UPI/SHAIK NIYA/x@o/milk/Kotak Mahi/563842971184/ICIab", 120.5, None, 1000, "BLR"],
        [2, "05/02/2024", "   ", None, 800, 1800, None],
    ])
    write_xlsx(b, HEADER, [[3, "2024-02-10", "NEFT/Salary", None, 50000.25, 51800]])
    with open(os.path.join(scratch, "notes.txt"), "w") as f:
        f.write("not a workbook")
    st = read_statements(spark, scratch, fmt="xlsx")
    rows = {r["s_no"]: r for r in st.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1]["txn_date_raw"] == "2024-01-31" and str(rows[1]["withdrawal"]) == "120.50"
    assert rows[1]["Branch"] == "BLR" and rows[3]["Branch"] is None
    assert rows[2]["remarks"] == "   " and rows[2]["withdrawal"] is None
    assert rows[3]["source_file"].endswith("feb.XLSX") and str(rows[3]["deposit"]) == "50000.25"
    with pytest.raises(ValueError):
        read_statements(spark, os.path.join(scratch, "notes.txt"), fmt="xlsx")


def test_csv_sink_round_trip(spark, scratch):
    df = spark.createDataFrame(
        [(1, ' lead "q" , trail ', "", None), (2, "plain", "x", "1234.50")],
        "s_no bigint, remarks string, category string, withdrawal string")
    out = os.path.join(scratch, "out.csv")
    write_csv(df.withColumn("withdrawal", F.col("withdrawal").cast("decimal(18,2)")), out)
    part = glob.glob(os.path.join(out, "part-*.csv"))
    lines = []
    for p in sorted(part):
        with open(p, newline="", encoding="utf-8") as f:
            lines += list(csv.reader(f))
    header = [l for l in lines if l[0] == "S No."][0]
    assert header == ["S No.", "Transaction Remarks", "Category", "Withdrawal Amount(INR)"]
    body = sorted([l for l in lines if l[0] != "S No."])
    assert body[0] == ["1", ' lead "q" , trail ', "", ""]
    assert body[1] == ["2", "plain", "x", "1234.50"]
    raw = "".join(open(p, encoding="utf-8").read() for p in part)
    assert '"" lead ""q"" , trail ""' not in raw and '" lead ""q"" , trail "' in raw
    assert default_output_path("/a/b/statement.xlsx") == "/a/b/statement.csv"


def test_csv_written_is_the_csv_read(spark, scratch):
    """Quotes, commas, line ends and backslashes survive the engine's own sink and reader."""
    from ledgerlens.sources import read_statements, write_csv
    rows = [(1, "01/02/2024", 'he said "hi", ok\nnext line', "5.00", None, "10.00"), (2, "02/02/2024", "back\\slash, comma", None, "7.50", "17.50"),
            (3, "03/02/2024", '"', "1.25", None, "16.25"), (4, "04/02/2024", "  spaces  ", "1.25", None, "15.00")]
    df = spark.createDataFrame(rows, "s_no long, txn_date_raw string, remarks string, withdrawal string, deposit string, balance string")
    out = f"{scratch}/out.csv"
    write_csv(df.withColumns({c: df[c].cast("decimal(18,2)") for c in ("withdrawal", "deposit", "balance")}), out)
    back = read_statements(spark, out, fmt="csv")
    pick = lambda d: sorted(tuple(str(x) for x in r) for r in d.select(*df.columns).collect())
    assert pick(back) == pick(df)
    assert back.select("source_file", "row_id").distinct().count() == 4
    assert [str(r["txn_date"]) for r in back.orderBy("s_no").collect()] == [f"2024-02-0{i}" for i in range(1, 5)]


def test_result_columns_of_an_earlier_run_are_overwritten(spark, scratch):
    from ledgerlens.operators.enrich import enrich_statement
    from ledgerlens.operators.rules import RuleBackend
    from ledgerlens.sources import write_csv
    df = spark.createDataFrame([(1, "01/02/2024", "UPI/A/milk", "5", None, "1", "Old", "old text")],
                               ", ".join(f"`{c}` string" for c in HEADER + ["Category", "Cleaned Remark"]).replace("`S No.` string", "`S No.` int"))
    st, _ = normalize_statement(df)
    out = enrich_statement(st, RuleBackend())
    assert [c.lower() for c in out.columns].count("category") == 1 and out.first()["category"] == "Groceries"
    write_csv(out, f"{scratch}/o.csv")
    assert spark.read.option("header", True).csv(f"{scratch}/o.csv").first()["Category"] == "Groceries"


def test_amounts_that_are_no_numbers(spark):
    from ledgerlens.operators.summary import quality_counts
    rows = [(i, "01/02/2024", "x", w, None, "1") for i, w in enumerate(["12.5", "abc", "", None, "1,234.50", " 7 "])]
    st, _ = normalize_statement(spark.createDataFrame(rows, ", ".join(f"`{c}` {'int' if c == 'S No.' else 'string'}" for c in HEADER)))
    assert {r["s_no"]: r["amount_unparseable"] for r in st.collect()} == {0: False, 1: True, 2: False, 3: False, 4: False, 5: False}
    q = quality_counts(st).first()
    assert (q["rows"], q["unparseable_amounts"], q["without_amount"], q["unparsed_dates"]) == (6, 1, 3, 0)


def test_output_paths_keep_the_scheme_and_dotted_folders():
    from ledgerlens.sources import default_output_path
    assert default_output_path("s3a://bucket/x.xlsx") == "s3a://bucket/x.csv"
    assert default_output_path("/a/stmts.2024/file.XLSX") == "/a/stmts.2024/file.csv"
    assert default_output_path("/a/b.c/plain") == "/a/b.c/plain.csv"


def test_wide_rows_missing_texts_and_dotted_folders_of_workbooks(spark, scratch):
    import os
    from ledgerlens.sources.workbook import read_workbooks
    from tests.xlsx_fixture import write_xlsx
    folder = os.path.join(scratch, "stmts.2024")
    os.makedirs(folder)
    write_xlsx(os.path.join(folder, "a.xlsx"), HEADER, [[1, "01/02/2024", "N/A", 5, None, 1, "beyond"], [2, "nan", "x", None, 5, 1]])
    got = {r["S No."]: r for r in read_workbooks(spark, folder).collect()}
    assert got["1"]["Unnamed: 6"] == "beyond" and got["1"]["Transaction Remarks"] is None
    assert got["2"]["Transaction Date"] is None and got["2"]["Unnamed: 6"] is None


def test_statements_of_one_name_stay_apart_by_source(spark, scratch):
    import os
    from ledgerlens.sources import write_csv
    df = spark.createDataFrame([(1, "/a/stmt.xlsx"), (2, "/b/stmt.xlsx")], "s_no long, source_file string")
    write_csv(df, f"{scratch}/o", partition_by_source=True)
    assert len([d for d in os.listdir(f"{scratch}/o") if d.startswith("source_file=")]) == 2


def test_a_large_statement_is_written_by_several_tasks(spark, scratch):
    import glob
    from ledgerlens.sources.sink import write_csv
    st = spark.range(4000).selectExpr("id AS s_no", "'01/02/2024' AS txn_date_raw", "md5(cast(id as string)) AS remarks",
                                      "cast(1 as decimal(18,2)) AS withdrawal", "cast(null as decimal(18,2)) AS deposit",
                                      "cast(null as decimal(18,2)) AS balance", "if(id % 50 = 0, 'small', 'large') AS source_file")
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        for name, keys in (("plain", None), ("sorted", ["s_no"])):
            path = f"{scratch}/{name}"
            write_csv(st.repartition(4), path, partition_by_source=True, sort_keys=keys)
            parts = sorted(glob.glob(f"{path}/source_file=large/part-*"))
            assert len(parts) > 1
            rows = [line.split(",")[0] for p in parts for line in open(p).read().splitlines()[1:]]
            want = [str(i) for i in range(4000) if i % 50]
            assert rows == want if keys else sorted(rows) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_costly_rows_are_spread_over_tasks_of_bounded_size(spark):
    from ledgerlens.session import spread_rows
    few, many = spark.range(0, 1000, 1, 2), spark.range(0, 1000, 1, 2)
    assert spread_rows(few, 1000, 1000).rdd.getNumPartitions() == 2
    dealt = spread_rows(many, 1000, 50)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 20 and max(sizes) <= 60 and sum(sizes) == 1000
