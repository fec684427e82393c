"""Joins that stay balanced when one key holds a large share of the rows.

Joining a large table back to a table with one row per key (stored replies,
the consensus reading per remark key) sends every row of a key to one task.
AQE's skew-join split does not help when the one-row-per-key side arrives
through an aggregate whose partitioning Spark reuses (no shuffle of its own
before the join), so hot keys are split explicitly:

* hot keys come from a per-key row count (the aggregate the caller already
  has, e.g. the prompt de-duplication): keys with more than ``split_rows``
  rows. There are at most ``rows / split_rows`` of them, whatever the keys, so
  the frame of hot keys is broadcast;
* each row of a hot key gets a salt in ``[0, pieces)`` with
  ``pieces = ceil(rows / split_rows)``, from a hash of the row's content, so
  a re-run task (after a lost executor) assigns every row the same salt
  whatever order its input arrives in; the key's single row on the other
  side is repeated once per salt; all other keys use salt 0;
* a row without a key matches nothing, but a left join still has to keep it:
  its salt comes from its content alone, so blank rows are spread over all
  tasks instead of meeting in one;
* the join runs on ``(key, salt)``, so a key with a third of all rows is
  spread over many tasks of about ``split_rows`` rows each.

Rows that are exact copies of each other share a salt (a statement row carries
its own ``s_no`` and ``source_file``, so its rows are not exact copies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key handled by one task after splitting.
HOT_SPLIT_ROWS = 1_000_000
# Salts that rows without a key are spread over.
NULL_KEY_SALTS = 1 << 20


def hot_keys(counts: DataFrame, key: str, n: str = "n", split_rows: int = HOT_SPLIT_ROWS) -> DataFrame:
    """``key, _pieces`` for the keys of ``counts`` (one row per key, ``n`` =
    its rows) holding more than ``split_rows`` rows."""
    return counts.where(F.col(n) > split_rows).select(
        key, F.ceil(F.col(n) / F.lit(split_rows)).cast("int").alias("_pieces"))


def split_hot_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame,
                   how: str = "left") -> DataFrame:
    """``left.join(right, key, how)`` for a ``right`` with at most one row
    per key, with the rows of each hot key (``hot`` from :func:`hot_keys`)
    spread over its pieces and the rows without a key over all tasks."""
    h = F.broadcast(hot)  # <= rows / split_rows rows
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    salted_left = (left.join(h, key, "left")
                   .withColumn("_salt", F.when(F.col(key).isNull(), F.pmod(row_hash, F.lit(NULL_KEY_SALTS)))
                               .when(F.col("_pieces").isNotNull(), F.pmod(row_hash, F.col("_pieces")))
                               .otherwise(F.lit(0)).cast("int"))
                   .drop("_pieces"))
    salted_right = (right.join(h, key, "left")
                    .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
                    .drop("_pieces"))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
