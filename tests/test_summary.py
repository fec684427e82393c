"""Summaries and questions on small hand-made statements."""

from decimal import Decimal

from ledgerlens.operators import questions, summary

SCHEMA = ("s_no bigint, txn_date_raw string, withdrawal decimal(18,2), deposit decimal(18,2), "
          "category string, subcategory string, party string")


def _df(spark):
    rows = [
        (1, "01/01/2024", Decimal("100.00"), None, "Food", "Snacks", "A"),
        (2, "15/01/2024", Decimal("50.00"), None, "Food", "  ", "B"),
        (3, "02/02/2024", None, Decimal("10.00"), "Refund", None, None),
        (4, "junk", Decimal("25.50"), None, None, "", None),
        (5, "03/02/2024", Decimal("70.00"), None, "Food", "Snacks", "A"),
        (6, None, None, None, "", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_totals(spark):
    t = summary.summary_totals(_df(spark)).first()
    assert t["total_transactions"] == 6
    assert t["total_withdrawals"] == Decimal("245.50") and t["total_deposits"] == Decimal("10.00")
    assert t["categories_found"] == 3  # Food, Refund and '' (missing excluded)
    assert t["subcategories_found"] == 1  # Snacks; blanks dropped, missing kept then not counted


def test_subcategories_absent_when_nothing_passes(spark):
    df = spark.createDataFrame([(1, "", "x")], "s_no bigint, subcategory string, category string")
    assert summary.summary_totals(df).first()["subcategories_found"] is None
    df = spark.createDataFrame([(1, None, "x")], "s_no bigint, subcategory string, category string")
    assert summary.summary_totals(df).first()["subcategories_found"] == 0


def test_breakdowns_and_spending(spark):
    df = _df(spark)
    assert [tuple(r) for r in summary.category_breakdown(df).collect()] == [
        ("Food", 3), ("", 1), ("Refund", 1)]
    assert [tuple(r) for r in summary.subcategory_breakdown(df).collect()] == [("Snacks", 2)]
    assert [tuple(r) for r in summary.category_spending(df).collect()] == [
        ("", Decimal("0.00")), ("Food", Decimal("220.00")), ("Refund", Decimal("0.00"))]


def test_date_range_and_context(spark):
    df = _df(spark)
    d = summary.date_range(df).first()
    assert (d["start_date"], d["end_date"], d["parsed_dates"]) == ("2024-01-01", "2024-02-03", 4)
    c = summary.chat_context(df).first()
    assert "- Date Range: 2024-01-01 to 2024-02-03" in c["context_text"]
    assert c["context_text"].endswith("- Food: ₹220.00\n- Refund: ₹0.00")


def test_report_order(spark):
    rep = [(r["section"], r["label"], r["value"]) for r in summary.summary_report(_df(spark)).collect()]
    assert rep[0][0] == "Totals" and ("Totals", "Total Withdrawals", "₹245.50") in rep
    # Totals in the order the statement summary prints them.
    assert [label for _s, label, _v in rep[:3]] == ["Total Transactions", "Total Withdrawals", "Total Deposits"]
    assert rep[3][1] == "Categories Found" and rep[4][0] == "Category Breakdown"
    assert rep.index(("Category Breakdown", "Food", "3")) < rep.index(("Category Breakdown", "Refund", "1"))


def test_questions(spark):
    df = _df(spark)
    s = questions.spend_on(df, "Snacks").first()
    assert (s["transactions"], s["spent"]) == (2, Decimal("170.00"))
    top = [r["category"] for r in questions.top_categories(df, 2).collect()]
    assert top == ["Food", ""]
    sc = questions.savings_candidates(df, "food", k=1).collect()
    assert len(sc) == 1 and sc[0]["payee"] == "A" and sc[0]["payee_rank"] == 1
    assert abs(sc[0]["share"] - 220 / 245.5) < 1e-12
    trend = [(r["month"], r["category"], r["prev_spent"]) for r in questions.monthly_trend(df).collect()]
    assert ("2024-02", "Food", Decimal("150.00")) in trend
