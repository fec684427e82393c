"""Statement schema: display names, engine names and types, column lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The statement's required columns (exact, case-sensitive, in
# declared order) and the result columns added by enrichment.
REQUIRED_COLUMNS = [
    "S No.",
    "Transaction Date",
    "Transaction Remarks",
    "Withdrawal Amount(INR)",
    "Deposit Amount(INR)",
    "Balance(INR)",
]

# Display name -> engine (snake_case) name.
ENGINE_NAMES = {
    "S No.": "s_no",
    "Transaction Date": "txn_date_raw",
    "Transaction Remarks": "remarks",
    "Withdrawal Amount(INR)": "withdrawal",
    "Deposit Amount(INR)": "deposit",
    "Balance(INR)": "balance",
    "Cleaned Remark": "cleaned_remark",
    "Notes / Doubts": "notes_doubts",
    "Category": "category",
    "Subcategory": "subcategory",
    "Confidence": "confidence",
}
DISPLAY_NAMES = {v: k for k, v in ENGINE_NAMES.items()}

MONEY = "decimal(18,2)"
ENGINE_TYPES = {
    "s_no": "bigint",
    "txn_date_raw": "string",
    "remarks": "string",
    "withdrawal": MONEY,
    "deposit": MONEY,
    "balance": MONEY,
}
STATEMENT_DDL = ", ".join(f"{k} {v}" for k, v in ENGINE_TYPES.items())
# Columns that ingest adds: the row's identity within its file, its date, and whether an amount is
# text that is no number. They are not part of the exported statement.
ROW_ID, TXN_DATE, AMOUNT_UNPARSEABLE = "row_id", "txn_date", "amount_unparseable"
INTERNAL_COLUMNS = [ROW_ID, TXN_DATE, AMOUNT_UNPARSEABLE]
# How many extra-column names the pass-through notice spells out.
EXTRA_NOTICE_NAMES = 5


class MissingColumnsError(ValueError):
    """Raised before any job starts when required statement columns are absent."""

    def __init__(self, missing: list[str]):
        self.missing = missing
        super().__init__(f"Missing required columns: {missing}")


def quote(name: str) -> str:
    """Backtick-quote a column name (names such as ``S No.`` hold a dot)."""
    return "`" + name.replace("`", "``") + "`"


def missing_required(columns: list[str]) -> list[str]:
    """Required display names absent from ``columns``, in declared order."""
    present = set(columns)
    return [c for c in REQUIRED_COLUMNS if c not in present]


def extra_columns(columns: list[str]) -> list[str]:
    req = set(REQUIRED_COLUMNS)
    return [c for c in columns if c not in req]


def extras_notice(extras: list[str]) -> str | None:
    """One-line notice naming the first few pass-through columns."""
    if not extras:
        return None
    names = ", ".join(extras[:EXTRA_NOTICE_NAMES])
    more = "..." if len(extras) > EXTRA_NOTICE_NAMES else ""
    return f"Keeping {len(extras)} column(s) beyond the statement's own: {names}{more}"


def find_col(df_or_cols, name: str, pick: str = "last") -> str | None:
    """Case-insensitive column lookup. ``pick='last'`` lets the last match win
    (statement summary); ``pick='first'`` the first (chat context)."""
    cols = df_or_cols.columns if isinstance(df_or_cols, DataFrame) else list(df_or_cols)
    hits = [c for c in cols if c.lower() == name.lower()]
    if not hits:
        return None
    return hits[-1] if pick == "last" else hits[0]


def description_column(columns: list[str]) -> str:
    """Which text the categoriser reads: the cleaned remark when that column
    exists (even if a value is empty), else the raw remark."""
    cols = set(columns)
    for c in ("cleaned_remark", "remarks"):
        if c in cols:
            return c
    raise ValueError("statement needs a cleaned_remark or remarks column")
