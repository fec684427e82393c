"""Statement summaries (totals, breakdowns, date range, per-category spend,
chat context, rendered report).

All are built-in aggregates: Spark plans a partial aggregate per task and a
final one after a single exchange, so a category holding a third of all rows
costs no more than any other (it collapses map-side). Inputs are engine-named
statements; results keep DECIMAL money (callers cast at the edge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import iso_date, with_statement_date
from ledgerlens.functions.text import is_blank, money_text, py_strip
from ledgerlens.schema import AMOUNT_UNPARSEABLE, MONEY, find_col, quote
from ledgerlens.session import materialize


def _kept_subcategory(c: Column) -> Column:
    """Rows kept by the non-empty-subcategory filter. A missing value is
    stringified ('nan') before the test, so it is kept (and later not counted)."""
    return c.isNull() | (py_strip(c.cast("string")) != "")


def grouped(df: DataFrame) -> DataFrame:
    """One pass over the statement: one row per (category, subcategory) with
    ``transactions``, ``withdrawals``, ``deposits``, ``start`` and ``end``. The
    totals, breakdowns and contexts below are all derived from these few rows."""
    cat = find_col(df, "category", pick="last")
    sub = find_col(df, "subcategory", pick="last")
    d = with_txn_date(df) if "txn_date_raw" in df.columns or "txn_date" in df.columns else df.withColumn(
        "txn_date", F.lit(None).cast("date"))
    amount = lambda n: F.col(n) if n in df.columns else F.lit(None).cast(MONEY)
    rows = d.select((F.col(quote(cat)) if cat else F.lit(None).cast("string")).alias("category"),
                    (F.col(quote(sub)) if sub else F.lit(None).cast("string")).alias("subcategory"),
                    amount("withdrawal").alias("withdrawal"), amount("deposit").alias("deposit"), "txn_date")
    return rows.groupBy("category", "subcategory").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("withdrawal").alias("withdrawals"),
        F.sum("deposit").alias("deposits"), F.min("txn_date").alias("start"), F.max("txn_date").alias("end"))


def totals_of(groups: DataFrame, has_category: bool, has_subcategory: bool) -> DataFrame:
    """:func:`summary_totals` of a :func:`grouped` statement."""
    s = F.col("subcategory")
    kept = F.count(F.when(_kept_subcategory(s), 1))
    distinct = F.count_distinct(F.when(_kept_subcategory(s), s))
    none = F.lit(None).cast("bigint")
    return groups.agg(
        F.coalesce(F.sum("transactions"), F.lit(0)).cast("bigint").alias("total_transactions"),
        F.coalesce(F.sum("withdrawals"), F.lit(0)).cast(MONEY).alias("total_withdrawals"),
        F.coalesce(F.sum("deposits"), F.lit(0)).cast(MONEY).alias("total_deposits"),
        (F.count_distinct("category") if has_category else none).alias("categories_found"),
        (F.when(kept > 0, distinct) if has_subcategory else none).alias("subcategories_found"))


def summary_totals(df: DataFrame) -> DataFrame:
    """One row: total_transactions, total_withdrawals, total_deposits,
    categories_found, subcategories_found (NULL when that column is absent,
    or, for subcategories, when no row has a non-empty value). The distinct
    counts run over the grouped rows, not over the statement."""
    return totals_of(grouped(df), find_col(df, "category") is not None, find_col(df, "subcategory") is not None)


def quality_counts(df: DataFrame) -> DataFrame:
    """One row: how many rows have an amount that is no number, no amount at
    all, and a date text that no accepted shape reads."""
    d = with_txn_date(df) if "txn_date_raw" in df.columns else df.withColumn("txn_date", F.lit(None).cast("date"))
    flag = F.col(AMOUNT_UNPARSEABLE) if AMOUNT_UNPARSEABLE in df.columns else F.lit(False)
    undated = (~is_blank(F.col("txn_date_raw")) & F.col("txn_date").isNull()) if "txn_date_raw" in df.columns else F.lit(False)
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("unparseable_amounts"),
                 F.count_if(F.col("withdrawal").isNull() & F.col("deposit").isNull()).alias("without_amount"),
                 F.count_if(undated).alias("unparsed_dates"))


def category_breakdown(df: DataFrame, name: str = "category") -> DataFrame:
    """Value counts of the category column: missing dropped, count descending,
    ties by value ascending (Spark keeps no first-seen order)."""
    c = find_col(df, name, pick="last")
    if c is None:
        raise ValueError(f"no {name} column")
    return (df.select(F.col(quote(c)).alias(name)).where(F.col(name).isNotNull())
            .groupBy(name).agg(F.count(F.lit(1)).alias("transactions"))
            .orderBy(F.desc("transactions"), F.asc(name)))


def subcategory_breakdown(df: DataFrame) -> DataFrame:
    """Value counts of non-empty subcategories (untrimmed values are the keys)."""
    c = find_col(df, "subcategory", pick="last")
    if c is None:
        raise ValueError("no subcategory column")
    s = F.col(quote(c))
    return (df.select(s.alias("subcategory"))
            .where(F.col("subcategory").isNotNull() & (py_strip("subcategory") != ""))
            .groupBy("subcategory").agg(F.count(F.lit(1)).alias("transactions"))
            .orderBy(F.desc("transactions"), F.asc("subcategory")))


def with_txn_date(df: DataFrame, raw: str = "txn_date_raw") -> DataFrame:
    """Add ``txn_date`` (DATE) parsed day-first from the raw date text."""
    if "txn_date" in df.columns:
        return df
    return with_statement_date(df, raw, "txn_date")


def date_range(df: DataFrame) -> DataFrame:
    """One row: start_date, end_date (``yyyy-MM-dd``, NULL if nothing parses),
    parsed_dates, total_rows."""
    d = with_txn_date(df)
    return d.agg(iso_date(F.min("txn_date")).alias("start_date"),
                 iso_date(F.max("txn_date")).alias("end_date"),
                 F.count("txn_date").alias("parsed_dates"),
                 F.count(F.lit(1)).alias("total_rows"))


def category_spending(df: DataFrame, pick: str = "first") -> DataFrame:
    """Withdrawals per category: missing keys dropped, keys ascending, a
    group whose amounts are all missing sums to 0."""
    c = find_col(df, "category", pick=pick)
    if c is None or "withdrawal" not in df.columns:
        return df.sparkSession.createDataFrame([], f"category string, spent {MONEY}")
    return (df.select(F.col(quote(c)).alias("category"), "withdrawal")
            .where(F.col("category").isNotNull())
            .groupBy("category")
            .agg(F.coalesce(F.sum("withdrawal"), F.lit(0).cast(MONEY)).alias("spent"))
            .orderBy("category"))


# The context's labels, one line per fact.
CONTEXT_HEADER = "Statement overview:"


def render_context(total: Column, start: Column, end: Column, cats: Column) -> Column:
    """Context text: count line; date line only when a start exists; one
    line per category (ascending) only when there are any."""
    lines = F.array(F.lit(CONTEXT_HEADER),
                    F.concat(F.lit("- Total Transactions: "), total.cast("string")))
    date_line = F.when(start.isNotNull(),
                       F.array(F.concat(F.lit("- Date Range: "), start, F.lit(" to "), end)))
    cat_lines = F.when(F.size(cats) > 0, F.concat(
        F.array(F.lit(""), F.lit("Spending by category:")),
        F.transform(cats, lambda x: F.concat(F.lit("- "), x["category"], F.lit(": "),
                                             money_text(x["spent"])))))
    empty = F.array().cast("array<string>")
    return F.array_join(F.concat(lines, F.coalesce(date_line, empty),
                                 F.coalesce(cat_lines, empty)), "\n")


def chat_context(df: DataFrame) -> DataFrame:
    """One row: total_transactions, start_date, end_date, categories
    (array of (category, spent) ascending) and the rendered context_text.

    The statement is read once, into one row per category; those rows are
    gathered into the context, which lists every category.
    """
    cat = find_col(df, "category", pick="first")
    spending = cat is not None and "withdrawal" in df.columns
    source = df if cat is None else df.select(*[F.col(quote(c)) for c in df.columns if c == cat or c.lower() != "category"])
    return context_of(grouped(source), spending)


def context_of(groups: DataFrame, spending: bool) -> DataFrame:
    """:func:`chat_context` of a :func:`grouped` statement; without ``spending`` no categories are listed."""
    per = groups.groupBy("category").agg(
        F.sum("transactions").alias("n"), F.coalesce(F.sum("withdrawals"), F.lit(0)).cast(MONEY).alias("spent"),
        F.min("start").alias("start"), F.max("end").alias("end"))
    listed = F.when(F.col("category").isNotNull() & F.lit(spending), F.struct("category", "spent"))
    ctx = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_transactions"),
                  iso_date(F.min("start")).alias("start_date"), iso_date(F.max("end")).alias("end_date"),
                  F.array_sort(F.collect_list(listed)).alias("categories"))
    return ctx.select("total_transactions", "start_date", "end_date", "categories",
                      render_context(F.col("total_transactions"), F.col("start_date"),
                                     F.col("end_date"), F.col("categories")).alias("context_text"))


def _counted(groups: DataFrame, name: str, section_no: int, section: str, kept: Column) -> DataFrame:
    counts = groups.where(kept).groupBy(F.col(name).alias("label")).agg(F.sum("transactions").alias("count"))
    return counts.select(F.lit(section_no).alias("section_no"), F.lit(1).alias("_line"), F.lit(section).alias("section"),
                         "label", F.col("count").cast("string").alias("value"), "count")


def summary_report(df: DataFrame) -> DataFrame:
    """Rendered summary as rows ``(section_no, section, label, value, count)``,
    sorted for display: sections in order, the totals as transactions,
    withdrawals, deposits, breakdown lines by ``count`` descending then label.
    Scalar lines carry a NULL count. Breakdown sections appear only when the
    column exists (and, for subcategories, when any row passes the filter).

    The statement is read once; its grouped rows are stored and every section comes from them.
    """
    return report_of(grouped(df), find_col(df, "category") is not None, find_col(df, "subcategory") is not None)


def report_of(groups: DataFrame, has_category: bool, has_subcategory: bool) -> DataFrame:
    """:func:`summary_report` of a :func:`grouped` statement, which is stored once."""
    groups = materialize(groups, "summary_groups")
    # Section names and labels of the single-file tool's summary.
    scalars = totals_of(groups, has_category, has_subcategory).select(F.expr(
        "stack(5, 1, 1, 'Totals', 'Total Transactions', cast(total_transactions as string),"
        " 1, 2, 'Totals', 'Total Withdrawals', concat('₹', format_number(total_withdrawals, 2)),"
        " 1, 3, 'Totals', 'Total Deposits', concat('₹', format_number(total_deposits, 2)),"
        " 2, 1, 'Categories', 'Categories Found', cast(categories_found as string),"
        " 4, 1, 'Subcategories', 'Subcategories Found', cast(subcategories_found as string))"
        " as (section_no, _line, section, label, value)")).where(F.col("value").isNotNull()).withColumn(
        "count", F.lit(None).cast("bigint"))
    out = scalars
    if has_category:
        out = out.unionByName(_counted(groups, "category", 3, "Category Breakdown", F.col("category").isNotNull()))
    if has_subcategory:
        out = out.unionByName(_counted(groups, "subcategory", 5, "Subcategory Breakdown",
                                       F.col("subcategory").isNotNull() & (py_strip("subcategory") != "")))
    return out.orderBy("section_no", "_line", F.desc_nulls_first("count"), "label").drop("_line")
