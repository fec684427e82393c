"""String helpers with Python ``str`` semantics, as native Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points Python's str.strip() removes by default
# (str.isspace). Written with \x{..} escapes, which both Java regex and RE2
# accept, so the same class text serves Spark and the DuckDB oracle.
PY_SPACE_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                   (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                   (0x3000, 0x3000)]
PY_SPACE_CLASS = "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b != a else "")
                               for a, b in PY_SPACE_RANGES) + "]"
PY_WHITESPACE = "".join(chr(c) for a, b in PY_SPACE_RANGES for c in range(a, b + 1))

# Fixed value: the currency sign used in every rendered amount.
RUPEE = "₹"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: trims Python's whitespace set from both ends (Spark's
    one-argument ``trim`` only trims U+0020). ``btrim`` with an explicit
    character set is a plain scan, no regex."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def as_text(c) -> Column:
    """Missing to empty string, anything else to its string form."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def is_blank(c) -> Column:
    """True when the value is missing or only whitespace."""
    return py_strip(as_text(c)) == F.lit("")


def money_text(c) -> Column:
    """``₹{:,.2f}``: thousands separators, two decimals (exact for DECIMAL input)."""
    return F.concat(F.lit(RUPEE), F.format_number(_c(c), 2))
