"""Property test: the native reply parsers agree with a plain-Python
statement of the parsing rules (regex search, ``json.loads``, type checks,
``str.strip``) on randomly generated replies."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.functions import with_parsed_category, with_parsed_remark
from ledgerlens.functions.replies import (CATEGORY_FIELDS, CONFIDENCE_LEVELS, ERR_NO_JSON,
                                          ERR_NOT_STRING, FALLBACK_CHARS, JSON_ERROR,
                                          MALFORMED_KEYWORDS, NO_DOUBT, NO_DOUBT_NOTES,
                                          REMARK_FIELDS, strict_pattern)

# ------------------------------------------------------------ expected values

def _find_object(reply, fields):
    m = re.search(strict_pattern(fields), reply, re.DOTALL) or re.search(r"\{.*\}", reply, re.DOTALL)
    return m.group(0) if m else None


def expect_category(reply):
    default = ("Unclear", "", "Low")
    if reply is None:
        return default
    js = _find_object(reply, CATEGORY_FIELDS)
    if js is None:
        return default
    try:
        obj = json.loads(js)
    except json.JSONDecodeError:
        low = reply.lower()
        for words, cat in MALFORMED_KEYWORDS:
            if any(w in low for w in words):
                return (cat, "", "Low")
        return default
    got = []
    for key, dflt in zip(CATEGORY_FIELDS, ("Unclear", "", "Low")):
        v = obj.get(key, dflt)
        if not isinstance(v, str):
            return default
        got.append(v.strip())
    cat, sub, conf = got
    return (cat or "Unclear", sub, conf if conf in CONFIDENCE_LEVELS else "Low")


def expect_remark(reply, error):
    if reply is None:
        return ("", f"Error: {error or 'no reply'}")
    js = _find_object(reply, REMARK_FIELDS)
    if js is None:
        return ("", ERR_NO_JSON)
    try:
        obj = json.loads(js)
    except json.JSONDecodeError:
        return (reply[:FALLBACK_CHARS], JSON_ERROR)
    vals = [obj.get(k, "") for k in REMARK_FIELDS]
    if not all(isinstance(v, str) for v in vals):
        return ("", ERR_NOT_STRING)
    cleaned, notes = (v.strip() for v in vals)
    return (cleaned, NO_DOUBT if notes.lower() in NO_DOUBT_NOTES else notes)


# ------------------------------------------------------------ reply grammar
TEXT = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=12)
PLAIN = st.text(alphabet="abc food petrol refund {}:,\" \n\t", max_size=15)
WORDS = st.sampled_from(["Fuel", " Travel ", "High", "high", "Medium", "Low", "", "—", "-", "NONE",
                         "null", "A{B}", "Food & Beverage", "　x ", "petrol"])
VALUES = st.one_of(WORDS, TEXT, st.none(), st.integers(-5, 5), st.sampled_from([0.5, True, False]),
                   st.lists(st.integers(0, 3), max_size=2), st.just({"a": "b"}))


@st.composite
def replies(draw, fields):
    keys = draw(st.lists(st.sampled_from(list(fields) + ["extra"]), max_size=5))
    obj = "{" + ", ".join(f"{json.dumps(k)}: {json.dumps(draw(VALUES))}" for k in keys) + "}"
    shape = draw(st.sampled_from(["plain", "trailing_comma", "single_quotes", "two_objects",
                                  "two_separate", "no_object", "null"]))
    if shape == "null":
        return None
    if shape == "no_object":
        return draw(PLAIN).replace("{", "(").replace("}", ")")
    if shape == "trailing_comma" and keys:
        obj = obj[:-1] + ",}"
    if shape == "single_quotes":
        obj = obj.replace('"', "'")
    if shape == "two_objects":
        obj = obj + "," + obj
    if shape == "two_separate":
        obj = obj + " then " + obj
    return draw(PLAIN) + obj + draw(PLAIN)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(replies(CATEGORY_FIELDS), min_size=40, max_size=80))
def test_category_parser_matches_python(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "i int, r string")
    got = {r["i"]: (r["category"], r["subcategory"], r["confidence"])
           for r in with_parsed_category(df, "r").collect()}
    for i, reply in enumerate(batch):
        assert got[i] == expect_category(reply), reply


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(replies(REMARK_FIELDS), st.sampled_from([None, "timeout"])),
                min_size=40, max_size=80))
def test_remark_parser_matches_python(spark, batch):
    rows = [(i, r, e) for i, (r, e) in enumerate(batch)]
    df = spark.createDataFrame(rows, "i int, r string, e string")
    got = {r["i"]: (r["cleaned_remark"], r["notes_doubts"]) for r in with_parsed_remark(df, "r", "e").collect()}
    for i, (reply, err) in enumerate(batch):
        assert got[i] == expect_remark(reply, err), reply
