"""Running totals of statements of any length, and the check of their balance column.

A window over a whole file would put a statement with a third of all rows into one task. Rows are dealt by ranges of
(file, order) instead: each range holds the blocks of one or more files, running totals are taken inside a block, and
a window over one row per block and file adds what came before. Tasks so hold a range of rows, never a file.

Awkward input: rows without a file are a file of their own; rows without an order value come first; of rows with one
order value, the smaller amounts come first (wholly equal rows are interchangeable); missing amounts count as zero; a row
without a balance is not checked, its amounts count; an empty statement gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.schema import quote
from ledgerlens.session import materialize

_FIRST = Window.unboundedPreceding


def _blocks(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """``df`` in ranges of (by, order), with ``_block``: the number of the range, ascending."""
    return df.repartitionByRange(*[F.col(quote(c)) for c in (by, *order)]).withColumn("_block", F.spark_partition_id())


def _in_block(by: str, order: Sequence[str]):
    return Window.partitionBy("_block", F.col(quote(by))).orderBy(*[F.col(quote(c)) for c in order])


def running_sum(df: DataFrame, by: str, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``by`` up to this one in ``order``."""
    keys = [f"_key{i}" for i in range(len(order))]
    rows = df.select(F.struct(*[F.col(quote(c)) for c in df.columns]).alias("_row"), F.col(quote(by)).alias("_by"),
                     *[F.col(quote(c)).alias(k) for c, k in zip(order, keys)], F.coalesce(value, F.lit(0)).alias("_value"))
    part = F.sum("_value").over(_in_block("_by", keys).rowsBetween(_FIRST, 0))
    rows = materialize(_blocks(rows, "_by", keys).withColumn("_part", part).drop(*keys), "running_sums")
    totals = rows.groupBy(F.col("_block").alias("_b"), F.col("_by").alias("_file")).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy("_file").orderBy("_b").rowsBetween(_FIRST, -1)  # one row per range the file lies in
    before = totals.select("_b", "_file", F.sum("_total").over(earlier).alias("_before"))
    joined = rows.join(before, (F.col("_block") == F.col("_b")) & F.col("_by").eqNullSafe(F.col("_file")))
    return joined.select(*[F.col(f"_row.{quote(c)}").alias(c) for c in df.columns if c != out],
                         (F.coalesce("_before", F.lit(0)) + F.col("_part")).alias(out))


def balance_breaks(df: DataFrame, by: str = "source_file", order: str = "s_no") -> DataFrame:
    """``by, transactions, checked, breaks, first_broken``: per file its rows, those with a balance, those whose balance
    is not the last one known plus deposits less withdrawals since, and the order value of the first such row."""
    rows = df.select(F.col(quote(by)).alias("_by"), F.col(quote(order)).alias("_order"), "balance", "withdrawal", "deposit",
                     (F.coalesce("deposit", F.lit(0)) - F.coalesce("withdrawal", F.lit(0))).alias("_move"))
    keys = ["_order", "balance", "withdrawal", "deposit"]
    w = _in_block("_by", keys)
    rows = (_blocks(rows, "_by", keys)
            .withColumns({"_at": F.row_number().over(w), "_sum": F.sum("_move").over(w.rowsBetween(_FIRST, 0))})
            .withColumn("_gap", F.col("balance") - F.col("_sum"))  # the same in all rows of a block that agree
            .withColumn("_last", F.last("_gap", ignorenulls=True).over(w.rowsBetween(_FIRST, -1))))
    broken, place = F.col("_gap") != F.col("_last"), F.struct("_at", "_order")
    known = F.when(F.col("_gap").isNotNull(), F.col("_at"))
    blocks = rows.groupBy("_block", "_by").agg(
        F.count(F.lit(1)).alias("n"), F.count("_gap").alias("checked"), F.sum("_move").alias("total"),
        F.min_by("_gap", known).alias("gap"), F.min(F.when(F.col("_gap").isNotNull(), place)).alias("start"),
        F.max_by("_gap", known).alias("end_gap"), F.count_if(broken).alias("breaks"), F.min(F.when(broken, place)).alias("broken"))
    earlier = Window.partitionBy("_by").orderBy("_block").rowsBetween(_FIRST, -1)  # one row per range the file lies in
    offset = F.coalesce(F.sum("total").over(earlier), F.lit(0))
    blocks = blocks.withColumn("_offset", offset).withColumns({"gap": F.col("gap") - F.col("_offset"), "end_gap": F.col("end_gap") - F.col("_offset")})
    blocks = blocks.withColumn("before", F.last("end_gap", ignorenulls=True).over(earlier))
    seam = F.coalesce(F.col("gap") != F.col("before"), F.lit(False))
    first = F.when(seam, F.col("start")).otherwise(F.col("broken"))
    return blocks.groupBy("_by").agg(
        F.sum("n").alias("transactions"), F.sum("checked").alias("checked"),
        F.sum(F.col("breaks") + seam.cast("long")).alias("breaks"),
        F.min(F.when(first.isNotNull(), F.struct("_block", first.alias("at")))).alias("_first")).select(
        F.col("_by").alias(by), "transactions", "checked", "breaks", F.col("_first.at._order").alias("first_broken"))
