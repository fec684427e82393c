"""Day-first statement dates.

Each value is parsed on its own against an ordered list of shapes; a value
matching no shape (or naming an impossible day) becomes NULL. Guessing one
format from the first row and applying it to the whole column is a row-order
dependence that does not survive partitioning, so it is not reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted shapes, in priority order: (regex, year, month, day
# group numbers; the month group may hold an English month name, short or full).
# A time of day may follow, with or without a zone; it is dropped.
_TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[AaPp][Mm])?(?:Z|[+-]\d{2}:?\d{2})?)?"
DATE_SHAPES = [
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _TIME + "$", 3, 2, 1),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})" + _TIME + "$", 3, 2, 1),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})" + _TIME + "$", 3, 2, 1),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})" + _TIME + "$", 1, 2, 3),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _TIME + "$", 1, 2, 3),
    (r"^(\d{1,2})[- /]([A-Za-z]{3,9})[- /,]{1,2}(\d{4})" + _TIME + "$", 3, 2, 1),
    (r"^(\d{1,2})[- /]([A-Za-z]{3,9})[- /](\d{2})$", 3, 2, 1),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})$", 3, 2, 1),
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
               "november", "december"]
# Two-digit years below this pivot are 20xx, the rest 19xx.
TWO_DIGIT_YEAR_PIVOT = 69


def _month_map() -> Column:
    names = {m: i for months in (MONTHS, MONTH_NAMES) for i, m in enumerate(months, start=1)}
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def _parts(s: Column) -> Column:
    """``[year, month, day, two_digit_flag]`` texts from the first shape that
    matches ``s`` (NULL when none does): one CASE, so each shape's regex is
    tested at most once and only the matching shape's groups are extracted."""
    expr = None
    for pattern, yi, mi, di in DATE_SHAPES:
        two_digit = "1" if pattern.endswith(r"(\d{2})$") else "0"
        val = F.array(F.regexp_extract(s, pattern, yi), F.regexp_extract(s, pattern, mi),
                      F.regexp_extract(s, pattern, di), F.lit(two_digit))
        cond = s.rlike(pattern)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def _assemble(p: Column) -> Column:
    """DATE from ``[year, month, day, two_digit_flag]``; NULL for an
    impossible date. Built from integers (no text round trip through a date
    parser): the first of the month, then the day if that month has it. The
    guard keeps make_date on valid input only, so ANSI mode never raises."""
    y0 = p[0].cast("int")
    y = (F.when((p[3] == "1") & (y0 < TWO_DIGIT_YEAR_PIVOT), y0 + 2000)
         .when(p[3] == "1", y0 + 1900).otherwise(y0))
    m = F.when(p[1].rlike(r"^\d+$"), p[1].cast("int")).otherwise(F.try_element_at(_month_map(), F.lower(p[1])))
    d = p[2].cast("int")
    first = F.when(y.between(0, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
    return F.when(d.between(1, 31) & (d <= F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))


def parse_statement_date(c) -> Column:
    """STRING -> DATE, day first; NULL when no shape matches or the day is
    invalid.

    The regex work (:func:`_parts`) appears once in the expression: the
    assembly reads it through a one-element ``transform``, which binds it to
    a lambda variable. Without that binding every reference to a part would
    copy the regex CASE, and a filter on the date (which the optimizer
    inlines into the scan) grew to thousands of regex calls per row."""
    s = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.element_at(F.transform(F.array(_parts(s)), _assemble), 1)


def with_statement_date(df: DataFrame, raw: str = "txn_date_raw", out: str = "txn_date") -> DataFrame:
    """Add ``out`` (DATE) parsed from ``raw``. The regex CASE is its own
    projected column (generated code, once per row); only the integer
    assembly runs through the lambda binding, and a filter on ``out`` still
    holds a single copy of the regex work."""
    s = F.trim(F.col(raw).cast("string"))
    d = df.withColumn("_dt_p", _parts(s))
    d = d.withColumn(out, F.element_at(F.transform(F.array(F.col("_dt_p")), _assemble), 1))
    return d.drop("_dt_p")


def iso_date(c) -> Column:
    """DATE -> ``yyyy-MM-dd`` text (``%Y-%m-%d``)."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


# Two numbers that may be day and month, in either order, before the year.
_LEADING_PAIR = r"^(\d{1,2})([-/.])(\d{1,2})([-/.])"


def with_statement_date_by_file(df: DataFrame, raw: str = "txn_date_raw", out: str = "txn_date", file: str = "source_file",
                                split_rows: int | None = None) -> DataFrame:
    """Add ``out`` (DATE) parsed from ``raw``, day and month in the order of the row's ``file``.

    Two passes. In the first, values that are a date in one order only (``13/02/2024``, ``02/13/2024``) vote for
    it; in the second, values that are one in both orders follow the majority of their file. A tie, a file without
    votes and rows without a file are day-first. Values with one possible order are read in it in any file, so a file
    that mixes both is right in those and follows the majority in the others. ISO texts and month names have one order.

    Votes are sums per file, combined before the shuffle; no file is gathered, and the one row per file is joined
    back with files of many rows split over tasks."""
    from ledgerlens.operators.joins import HOT_SPLIT_ROWS, hot_keys, split_hot_join
    from ledgerlens.session import materialize
    read = df.withColumn("_swapped", F.regexp_replace(F.trim(F.col(raw).cast("string")), _LEADING_PAIR, "$3$2$1$4"))
    read = with_statement_date(with_statement_date(read, raw, "_day_first"), "_swapped", "_month_first").drop("_swapped")
    votes = materialize(read.where(F.col(file).isNotNull()).groupBy(file).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_day_first").isNotNull() & F.col("_month_first").isNull()).alias("day"),
        F.count_if(F.col("_month_first").isNotNull() & F.col("_day_first").isNull()).alias("month")), "date_votes")
    order = votes.select(file, (F.col("month") > F.col("day")).alias("_month_files"))
    read = split_hot_join(read, order, file, hot_keys(votes, file, split_rows=split_rows or HOT_SPLIT_ROWS))
    first, second = F.col("_day_first"), F.col("_month_first")
    date = F.when(F.coalesce("_month_files", F.lit(False)), F.coalesce(second, first)).otherwise(F.coalesce(first, second))
    return read.select(*[F.col(f"`{c}`") for c in df.columns if c != out], date.alias(out))
