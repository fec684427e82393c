"""Model-reply parsing as native column expressions.

A reply is free text that should hold one JSON object. The branch order is
what matters: (1) call failed, (2) no object found, (3) object is not valid
JSON, (4) a wanted field is null or not a string, (5) normal values, each
with its own defaults. ``from_json`` would hide (3) and (4) (it stringifies
numbers and ignores trailing text), so the object is parsed as a VARIANT and
each field's JSON type is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import py_strip

# Reply fields, in the order a well-formed reply lists them.
REMARK_FIELDS = ("cleaned_remark", "notes_doubts")
CATEGORY_FIELDS = ("category", "subcategory", "confidence")

# The allowed confidence levels (exact, case-sensitive).
CONFIDENCE_LEVELS = ("High", "Medium", "Low")
# Note texts that mean "no doubt", compared lower-cased; all
# become the dash below.
NO_DOUBT_NOTES = ("", "—", "-", "none", "null")
NO_DOUBT = "—"
# Keyword groups tried, in order, on a reply whose JSON is
# malformed (substring match on the lower-cased reply; first group wins).
MALFORMED_KEYWORDS = [
    (("fuel", "petrol", "diesel"), "Fuel"),
    (("grocery", "food", "restaurant"), "Food"),
    (("refund", "reversal"), "Refund"),
]
# Defaults of a categorisation that could not be read.
UNCLEAR = "Unclear"
LOW = "Low"

# Stable result codes (the engine does not echo interpreter error text).
ERR_NO_JSON = "Error: no JSON in reply"
ERR_NOT_STRING = "Error: field is not a string"
ERR_NO_REPLY = "Error: no reply"
JSON_ERROR = "JSON parsing error"
# Characters of the raw reply kept as the remark when its JSON is malformed.
FALLBACK_CHARS = 200

LOOSE_PATTERN = r"(?s)\{.*\}"


def strict_pattern(fields) -> str:
    """First brace-free object naming ``fields`` in this order."""
    body = r"[^{}]*".join(f'"{f}"' for f in fields)
    return r"\{[^{}]*" + body + r"[^{}]*\}"


def malformed_reply_category(reply: Column) -> Column:
    low = F.lower(reply)
    expr = None
    for words, cat in MALFORMED_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        expr = F.when(hit, F.lit(cat)) if expr is None else expr.when(hit, F.lit(cat))
    return expr.otherwise(F.lit(UNCLEAR))


# Each costly step (regex extract, JSON parse) is its own projected column,
# referenced several times downstream, so the optimizer keeps it as one
# evaluation per row instead of inlining copies into every branch. The ``[..]``
# wrapper turns text after the object into a parse failure or a second element.

def _staged(df: DataFrame, reply: str, fields, tmp: str) -> DataFrame:
    strict, js, v = f"{tmp}_strict", f"{tmp}_js", f"{tmp}_v"
    df = df.withColumn(strict, F.regexp_extract(F.col(reply), strict_pattern(fields), 0))
    df = df.withColumn(js, F.when(F.col(strict) != "", F.col(strict))
                       .otherwise(F.regexp_extract(F.col(reply), LOOSE_PATTERN, 0))).drop(strict)
    df = df.withColumn(v, F.try_parse_json(F.concat(F.lit("["), F.col(js), F.lit("]"))))
    cols = {f"{tmp}_bad": F.col(v).isNull() | F.variant_get(v, "$[1]", "variant").isNotNull()}
    for i, f in enumerate(fields):
        cols[f"{tmp}_k{i}"] = F.schema_of_variant(F.variant_get(v, f"$[0].{f}", "variant"))
        cols[f"{tmp}_s{i}"] = F.try_variant_get(v, f"$[0].{f}", "string")
    return df.withColumns(cols).drop(v)


def _bad_type(tmp: str, n: int) -> Column:
    out = F.lit(False)
    for i in range(n):
        k = F.col(f"{tmp}_k{i}")
        out = out | (k.isNotNull() & (k != F.lit("STRING")))
    return out


def with_parsed_remark(df: DataFrame, reply: str = "response", error: str | None = "error",
                       tmp: str = "_pr") -> DataFrame:
    """Add ``cleaned_remark`` and ``notes_doubts`` parsed from ``reply``."""
    d = _staged(df, reply, REMARK_FIELDS, tmp)
    r = F.col(reply)
    err = F.col(error) if error else F.lit(None).cast("string")
    js, malformed, bad = F.col(f"{tmp}_js"), F.col(f"{tmp}_bad"), _bad_type(tmp, 2)
    cleaned = py_strip(F.coalesce(F.col(f"{tmp}_s0"), F.lit("")))
    notes = py_strip(F.coalesce(F.col(f"{tmp}_s1"), F.lit("")))
    notes = F.when(F.lower(notes).isin(*NO_DOUBT_NOTES), F.lit(NO_DOUBT)).otherwise(notes)
    failed = r.isNull()
    d = d.withColumns({
        "cleaned_remark": (F.when(failed | (js == ""), F.lit(""))
                           .when(malformed, F.substring(r, 1, FALLBACK_CHARS))
                           .when(bad, F.lit("")).otherwise(cleaned)),
        "notes_doubts": (F.when(failed, F.concat(F.lit("Error: "), F.coalesce(err, F.lit("no reply"))))
                         .when(js == "", F.lit(ERR_NO_JSON))
                         .when(malformed, F.lit(JSON_ERROR))
                         .when(bad, F.lit(ERR_NOT_STRING)).otherwise(notes)),
    })
    return d.drop(*[c for c in d.columns if c.startswith(tmp + "_")])


def with_parsed_category(df: DataFrame, reply: str = "response", tmp: str = "_pc") -> DataFrame:
    """Add ``category``, ``subcategory`` and ``confidence`` parsed from ``reply``."""
    d = _staged(df, reply, CATEGORY_FIELDS, tmp)
    r = F.col(reply)
    js, malformed, bad = F.col(f"{tmp}_js"), F.col(f"{tmp}_bad"), _bad_type(tmp, 3)
    cat = py_strip(F.coalesce(F.col(f"{tmp}_s0"), F.lit(UNCLEAR)))
    sub = py_strip(F.coalesce(F.col(f"{tmp}_s1"), F.lit("")))
    conf = py_strip(F.coalesce(F.col(f"{tmp}_s2"), F.lit(LOW)))
    default = r.isNull() | (js == "")
    d = d.withColumns({
        "category": (F.when(default, F.lit(UNCLEAR))
                     .when(malformed, malformed_reply_category(r))
                     .when(bad, F.lit(UNCLEAR))
                     .when(cat == "", F.lit(UNCLEAR)).otherwise(cat)),
        "subcategory": F.when(default | malformed | bad, F.lit("")).otherwise(sub),
        "confidence": (F.when(default | malformed | bad, F.lit(LOW))
                       .when(conf.isin(*CONFIDENCE_LEVELS), conf).otherwise(F.lit(LOW))),
    })
    return d.drop(*[c for c in d.columns if c.startswith(tmp + "_")])
