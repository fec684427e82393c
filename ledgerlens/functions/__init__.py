"""Column -> Column helpers. Everything here is a built-in Spark expression
(whole-stage codegen friendly); nothing calls back into Python per row."""

from ledgerlens.functions.text import (PY_SPACE_CLASS, as_text, is_blank, money_text,
                                       py_strip)
from ledgerlens.functions.dates import iso_date, parse_statement_date
from ledgerlens.functions.replies import (with_parsed_category, with_parsed_remark,
                                          CATEGORY_FIELDS, REMARK_FIELDS)

__all__ = ["PY_SPACE_CLASS", "as_text", "is_blank", "money_text", "py_strip",
           "iso_date", "parse_statement_date", "with_parsed_category",
           "with_parsed_remark", "CATEGORY_FIELDS", "REMARK_FIELDS"]
