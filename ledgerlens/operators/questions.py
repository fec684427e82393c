"""Answers to the spending questions a user asks about a categorised
statement: spend on X, top categories, where to save on X, monthly trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.summary import category_spending, with_txn_date
from ledgerlens.schema import MONEY
from ledgerlens.session import materialize


def _zero():
    return F.lit(0).cast(MONEY)


def spend_on(df: DataFrame, term: str) -> DataFrame:
    """One row: how much was spent on ``term`` (a category or subcategory,
    case-insensitive): transactions, spent, received."""
    t = term.strip().lower()
    hit = (F.lower("category") == t) | (F.lower("subcategory") == t)
    return (df.where(hit)
            .agg(F.count(F.lit(1)).alias("transactions"),
                 F.coalesce(F.sum("withdrawal"), _zero()).alias("spent"),
                 F.coalesce(F.sum("deposit"), _zero()).alias("received"))
            .select(F.lit(t).alias("term"), "transactions", "spent", "received"))


def top_categories(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` categories with the largest withdrawals (ties by name).
    Planned as a distributed top-k (each task keeps k rows)."""
    return category_spending(df).orderBy(F.desc("spent"), F.asc("category")).limit(k)


def savings_candidates(df: DataFrame, term: str, k: int = 3, party_col: str = "party") -> DataFrame:
    """Where to save on ``term``: the category's share of all withdrawals,
    count, mean, and its ``k`` largest payees (one row per payee, ranked).

    The statement is read once: grouped by whether the category is the term
    and by payee, and stored. The totals are sums of those rows, and the ranking is
    a distributed top-k of them, so no single task sees more than one partition of
    payees.
    """
    t = term.strip().lower()
    mine = F.coalesce(F.lower("category") == t, F.lit(False))
    groups = materialize(
        df.select(mine.alias("mine"), F.when(mine, F.col(party_col)).alias("payee"), "withdrawal")
        .groupBy("mine", "payee").agg(F.count(F.lit(1)).alias("n"), F.count("withdrawal").alias("paid"),
                                      F.sum("withdrawal").alias("spent")), "savings_groups")
    stats = groups.agg(F.coalesce(F.sum(F.when(F.col("mine"), F.col("n"))), F.lit(0)).cast("bigint").alias("transactions"),
                       F.coalesce(F.sum(F.when(F.col("mine"), F.col("spent"))), _zero()).cast(MONEY).alias("spent"),
                       F.coalesce(F.sum("spent"), _zero()).alias("all_spent"))
    top = (groups.where(F.col("mine") & F.col("payee").isNotNull() & (F.col("paid") > 0))
           .orderBy(F.desc("spent"), F.asc("payee")).limit(k)
           .select(F.struct(F.negative("spent").alias("low"), "payee", "paid").alias("p")))
    # At most k rows (limit above), gathered beside the one row of totals and spread out again by rank.
    ranked = top.agg(F.array_sort(F.collect_list("p")).alias("payees"))
    one = F.lit(1).alias("_one")  # both sides are global aggregates of one row
    out = stats.select("*", one).join(F.broadcast(ranked.select("*", one)), "_one").select(
        "*", F.posexplode_outer("payees").alias("at", "p"))
    return out.select(
        F.lit(t).alias("term"), "transactions", "spent",
        F.when(F.col("transactions") > 0, F.col("spent").cast("double") / F.col("transactions")).alias("avg_spent"),
        F.when(F.col("all_spent") > 0, F.col("spent").cast("double") / F.col("all_spent").cast("double")).alias("share"),
        (F.col("at") + 1).alias("payee_rank"), F.col("p.payee").alias("payee"),
        F.negative("p.low").cast(MONEY).alias("payee_spent"), F.col("p.paid").alias("payee_transactions"))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Withdrawals per (month, category) with the amount of the calendar month
    before in the same category, and the change (both NULL where the category
    has no transaction in that month). Rows whose date does not parse have no
    month and are left out.

    The window runs over the aggregated table (one row per category-month),
    so a hot category contributes at most one row per month to its window.
    """
    d = with_txn_date(df) if "txn_date" not in df.columns else df
    monthly = (d.where(F.col("txn_date").isNotNull() & F.col("category").isNotNull())
               .groupBy(F.trunc("txn_date", "month").alias("_month"), "category")
               .agg(F.coalesce(F.sum("withdrawal"), _zero()).alias("spent"),
                    F.count(F.lit(1)).alias("transactions")))
    w = Window.partitionBy("category").orderBy("_month")
    before = F.lag("_month").over(w) == F.add_months("_month", -1)
    return (monthly.withColumn("prev_spent", F.when(before, F.lag("spent").over(w)))
            .select(F.date_format("_month", "yyyy-MM").alias("month"), "category", "spent", "transactions", "prev_spent",
                    (F.col("spent") - F.col("prev_spent")).alias("change"))
            .orderBy("category", "month"))
