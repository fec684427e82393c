"""Test inputs derived from the driver's tables.

The statement comes from ``orders`` joined to ``customer``; synthetic model
replies are assigned to every statement row by ``s_no`` so each parser
branch is exercised on the whole table (nothing is filtered or sampled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import spread
from ledgerlens.sources.statement import derive_statement

# Fixed test values: category replies by branch (s_no % 12). None = failed call.
CATEGORY_REPLIES = [
    '{"category":"Fuel","subcategory":"Petrol","confidence":"High"}',
    'Sure! {"category":" Travel ","subcategory":"Train","confidence":"high"} done',
    '{"confidence":"Low","subcategory":"","category":"Refund"}',
    'I think this is petrol',
    '{"category":"Petrol station","subcategory":"x","confidence":"High",}',
    '{"category":"","subcategory":"","confidence":"Medium"}',
    '{"category":"Groceries","subcategory":null,"confidence":"High"}',
    '{"category":"Bills","subcategory":"Water","confidence":0.9}',
    '{"category":"Food"} {"subcategory":"seafood"}',
    '{"category":"Bills"}',
    None,
    '{"category":"A{B}","subcategory":"s","confidence":"Medium"}',
]
# Fixed test values: remark replies by branch (s_no % 10). None = failed call.
REMARK_REPLIES = [
    '{"cleaned_remark":"Rent August","notes_doubts":""}',
    'ok {"cleaned_remark":" Milk ","notes_doubts":"NONE"}',
    '{"notes_doubts":"maybe","cleaned_remark":"Ticket"}',
    '{"cleaned_remark":"Only"}',
    '{"cleaned_remark":"Broken","notes_doubts":"x",}',
    'no object here',
    '{"cleaned_remark":null,"notes_doubts":"x"}',
    '{"cleaned_remark":7,"notes_doubts":"x"}',
    None,
    '{"cleaned_remark":"","notes_doubts":"-"}',
]
FAILED_CALL_ERROR = "timeout"


def _pick(key, replies):
    n = len(replies)
    expr = None
    for i, r in enumerate(replies):
        v = F.lit(r).cast("string")
        expr = F.when(key % n == i, v) if expr is None else expr.when(key % n == i, v)
    return expr


def _failed(key, replies):
    bad = [i for i, r in enumerate(replies) if r is None]
    return F.when((key % len(replies)).isin(*bad), F.lit(FAILED_CALL_ERROR))


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_statement(spark, sf_dir)


def remark_reply_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(s_no, response, error)``: one stored remark reply per statement row."""
    k = F.col("o_orderkey")
    return (spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")).select(
        k.alias("s_no"), _pick(k, REMARK_REPLIES).alias("response"),
        _failed(k, REMARK_REPLIES).alias("error")))


def category_reply_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(s_no, response, error)``: one stored category reply per statement row."""
    k = F.col("o_orderkey")
    return (spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")).select(
        k.alias("s_no"), _pick(k, CATEGORY_REPLIES).alias("response"),
        _failed(k, CATEGORY_REPLIES).alias("error")))
