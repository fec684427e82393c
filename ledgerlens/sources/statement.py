"""Statement ingest: validate display columns, map to engine names and types.

Many statements are read into one DataFrame; ``source_file`` keeps track of
where each row came from. Validation runs on the driver against the schema
only (no job), so a bad file set fails before any work starts.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import spread, spread_rows
from ledgerlens.functions.dates import with_statement_date, with_statement_date_by_file
from ledgerlens.functions.text import is_blank
from ledgerlens.schema import (AMOUNT_UNPARSEABLE, DISPLAY_NAMES, ENGINE_NAMES, ENGINE_TYPES, MONEY,
                               MissingColumnsError, REQUIRED_COLUMNS, ROW_ID, TXN_DATE, extra_columns,
                               extras_notice, missing_required, quote)

log = logging.getLogger(__name__)

# Fixed value: the only workbook suffix accepted (compared case-insensitively).
WORKBOOK_SUFFIX = ".xlsx"


def _numeric_or_text(c: Column, dtype: str, target: str) -> Column:
    """Coerce an input cell: NaN -> NULL (Spark sums NaN, pandas skips it),
    text -> try_cast (unparseable -> NULL)."""
    if dtype in ("double", "float"):
        c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
    elif dtype == "string":
        c = F.regexp_replace(F.trim(c), ",", "")
    return c.try_cast(target)


def _not_a_number(c: Column, dtype: str, value: Column) -> Column:
    """Text that is there but names no amount."""
    return (~is_blank(c) & value.isNull()) if dtype == "string" else F.lit(False)


def normalize_statement(df: DataFrame, keep_extras: bool = True,
                        carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Display-named statement -> engine-named, typed statement.

    Returns ``(statement, extras)``. Raises :class:`MissingColumnsError`
    listing every absent required column in declared order. Result columns of
    an earlier run take their engine names, so enriching again overwrites
    them; other extra columns pass through as strings under their own names.
    ``amount_unparseable`` marks rows whose withdrawal or deposit is text that
    names no amount.
    """
    cols = df.columns
    missing = missing_required(cols)
    if missing:
        raise MissingColumnsError(missing)
    extras = [c for c in extra_columns(cols) if c not in carry]
    note = extras_notice(extras)
    if note:
        log.info(note)
    types = dict(df.dtypes)
    out, bad = [], F.lit(False)
    for disp in REQUIRED_COLUMNS:
        eng = ENGINE_NAMES[disp]
        c = F.col(quote(disp))
        t = types[disp]
        if eng == "s_no":
            c = _numeric_or_text(c, t, "bigint")
        elif eng in ("withdrawal", "deposit", "balance"):
            value = _numeric_or_text(c, t, MONEY)
            if eng != "balance":
                bad = bad | _not_a_number(c, t, value)
            c = value
        elif eng == "txn_date_raw":
            c = (F.date_format(c, "yyyy-MM-dd") if t in ("date",)
                 else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp")
                 else c.cast("string"))
        else:
            c = c.cast("string")
        out.append(c.alias(eng))
    if keep_extras:
        out += [F.col(quote(e)).cast("string").alias(ENGINE_NAMES.get(e, e)) for e in extras]
    out += [F.col(quote(c)) for c in carry]
    return df.select(*out, bad.alias(AMOUNT_UNPARSEABLE)), extras


def statement_to_display(df: DataFrame) -> DataFrame:
    """Engine names back to the exact display names (used at the sink)."""
    return df.select(*[F.col(quote(c)).alias(DISPLAY_NAMES.get(c, c)) for c in df.columns])


def _check_paths(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.globStatus(path):
            raise FileNotFoundError(f"File not found: {p}")


# How the CSV sink writes, which is what its reader expects. Cells may hold line breaks, so a file is one task; the option
# multiLine=false, for files known to hold none, lets Spark split large ones.
CSV_READ_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "emptyValue": "",
                    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_statements(spark: SparkSession, paths, fmt: str = "parquet",
                    options: dict | None = None, date_order: str = "day_first") -> DataFrame:
    """Read statement files (``parquet``, ``csv`` or ``xlsx``) into one
    validated, engine-named DataFrame with ``source_file``, ``row_id`` (which
    names the row within its file; numbered from 1 in workbooks and parquet
    files, unique but with gaps in CSV) and ``txn_date``.

    ``xlsx`` uses the workbook data source (one partition per workbook);
    other suffixes are rejected for it, as for the single-file tool.

    ``date_order``: ``day_first``, or ``by_file`` to let the dates of each file say
    whether it is month-first (:func:`ledgerlens.functions.dates.with_statement_date_by_file`).
    """
    if date_order not in ("day_first", "by_file"):
        raise ValueError(f"unknown date_order: {date_order}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    _check_paths(spark, paths)
    opts = dict(options or {})
    if fmt == "xlsx":
        from ledgerlens.sources.workbook import read_workbooks
        raw = read_workbooks(spark, paths)
        src, row = F.col("_source_file"), F.col("_row_id")
    else:
        if fmt == "csv":
            opts = {**CSV_READ_OPTIONS, **opts}
        raw = spark.read.options(**opts).format(fmt).load(paths)
        src = F.col("_metadata.file_path")
        row = F.col("_metadata.row_index") + 1 if fmt == "parquet" else F.monotonically_increasing_id() + 1
    raw = raw.withColumns({"_src": src, "_row": row}).drop("_source_file", "_row_id")
    stmt, _ = normalize_statement(raw, keep_extras=True, carry=("_src", "_row"))
    stmt = stmt.withColumnsRenamed({"_src": "source_file", "_row": ROW_ID})
    return (with_statement_date_by_file if date_order == "by_file" else with_statement_date)(stmt, out=TXN_DATE)


def derive_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test statement derived from ``orders`` and ``customer`` (engine names).

    Every order is one transaction; the join is a plain equi-join on the
    customer key, left to the planner (AQE turns it into a broadcast only
    when the runtime size of ``customer`` is under Spark's own threshold).
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    rows = o.count()  # from the files' footers
    o = spread(o)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    j = spread_rows(o.join(c, o.o_custkey == c.c_custkey, "inner").drop("o_custkey", "c_custkey"), rows)
    k = F.col("o_orderkey")
    key_text = k.cast("string")
    txn_date = (F.when(k % 11 == 0, F.lit(None).cast("string"))
                .when(k % 11 == 1, F.lit("not a date"))
                .when(k % 11 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
                .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")))
    purpose = (F.when(k % 7 == 0, "temp rever").when(k % 7 == 1, "savings oc")
               .when(k % 7 == 2, "petrol bik").when(k % 7 == 3, "milk")
               .when(k % 7 == 4, "IRCTC ticket").when(k % 7 == 5, "rent au")
               .otherwise("Pay to"))
    tail = F.concat(F.lit("/Kotak Mahi/"), F.lpad(key_text, 12, "5"), F.lit("/ICI"), F.md5(key_text))
    form = k % 19  # 0-9: the common form; the others make every reading and category rule fire
    remark = (F.when(form == 10, F.concat(F.lit("NEFT/"), F.col("c_name"), F.lit("/Pay to"), tail))
              .when(form == 11, F.concat(F.lit("IMPS/AMAZON/Pay to"), tail))
              .when(form == 12, F.lit("Paytm"))
              .when(form == 13, F.lpad(key_text, 12, "5"))
              .when(form == 14, F.concat(F.lit("ICI"), F.md5(key_text)))
              .when(form == 15, F.concat(F.lit("NEFT/ACME CORP/salary"), tail))
              .when(form == 16, F.concat(F.lit("UPI/FAMILY TRUST/Pay to"), tail))
              .when(form == 17, F.concat(F.lit("NEFT/FREELANCE DESK/payment fr"), tail))
              .when(form == 18, F.concat(F.lit("IMPS/ATM CASH/Pay to"), tail))
              .otherwise(F.concat(F.lit("UPI/"), F.col("c_name"), F.lit("/"), purpose, tail)))
    remarks = (F.when(k % 13 == 0, F.lit(None).cast("string"))
               .when(k % 13 == 1, F.lit("   ")).otherwise(remark))
    amount = (F.when(form == 10, F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice"))).cast(MONEY)
    return j.select(
        k.alias("s_no"),
        txn_date.alias("txn_date_raw"),
        remarks.alias("remarks"),
        F.when(F.col("o_orderstatus") != "F", amount).alias("withdrawal"),
        F.when(F.col("o_orderstatus") == "F", amount).alias("deposit"),
        F.col("c_acctbal").cast(MONEY).alias("balance"),
    )


assert set(ENGINE_TYPES) <= set(DISPLAY_NAMES)
