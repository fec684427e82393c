"""Reply parsing: every branch of FIXTURES.md section 4, plus edge cases."""

import pytest

from ledgerlens.functions import with_parsed_category, with_parsed_remark
from ledgerlens.plans.fixtures import CATEGORY_REPLIES, REMARK_REPLIES

CATEGORY_EXPECTED = [
    ("Fuel", "Petrol", "High"), ("Travel", "Train", "Low"), ("Refund", "", "Low"),
    ("Unclear", "", "Low"), ("Fuel", "", "Low"), ("Unclear", "", "Medium"),
    ("Unclear", "", "Low"), ("Unclear", "", "Low"), ("Food", "", "Low"),
    ("Bills", "", "Low"), ("Unclear", "", "Low"), ("A{B}", "s", "Medium"),
]
REMARK_EXPECTED = [
    ("Rent August", "—"), ("Milk", "—"), ("Ticket", "maybe"), ("Only", "—"),
    (REMARK_REPLIES[4], "JSON parsing error"), ("", "Error: no JSON in reply"),
    ("", "Error: field is not a string"), ("", "Error: field is not a string"),
    ("", "Error: timeout"), ("", "—"),
]


def test_category_branches(spark):
    df = spark.createDataFrame(list(enumerate(CATEGORY_REPLIES)), "i int, r string")
    staged = {r["i"]: (r["category"], r["subcategory"], r["confidence"])
              for r in with_parsed_category(df, "r").collect()}
    for i, exp in enumerate(CATEGORY_EXPECTED):
        assert staged[i] == exp, i


def test_remark_branches(spark):
    rows = [(i, r, "timeout" if r is None else None) for i, r in enumerate(REMARK_REPLIES)]
    df = spark.createDataFrame(rows, "i int, r string, e string")
    staged = {r["i"]: (r["cleaned_remark"], r["notes_doubts"])
              for r in with_parsed_remark(df, "r", "e").collect()}
    for i, exp in enumerate(REMARK_EXPECTED):
        assert staged[i] == exp, i


@pytest.mark.parametrize("reply,expected", [
    ('{"category":"A","category":"B","subcategory":"","confidence":"High"}', ("B", "", "High")),
    ('{"category":"\\u00a0Fuel\\u3000","subcategory":"x","confidence":"Medium"}', ("Fuel", "x", "Medium")),
    ('{"category":"Fuel","subcategory":"x","confidence":"High"} trailing', ("Fuel", "x", "High")),
    ('{"category": {"a": 1}}', ("Unclear", "", "Low")),
    ("{'category': 'refund'}", ("Refund", "", "Low")),
    ('{"category":"x","subcategory":"y","confidence":"Low"}\n{"extra": 1}', ("x", "y", "Low")),
    ("", ("Unclear", "", "Low")),
])
def test_category_edges(spark, reply, expected):
    df = spark.createDataFrame([(reply,)], "r string")
    r = with_parsed_category(df, "r").first()
    assert (r["category"], r["subcategory"], r["confidence"]) == expected


def test_fallback_keeps_200_code_points(spark):
    reply = "{" + "₹😀" * 150 + ",}"
    df = spark.createDataFrame([(reply, None)], "r string, e string")
    r = with_parsed_remark(df, "r", "e").first()
    assert r["cleaned_remark"] == reply[:200]
    assert r["notes_doubts"] == "JSON parsing error"
