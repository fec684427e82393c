"""Difference of two exports of one account, as bags of rows.

Statements are downloaded again and again, over times that overlap, and rows are corrected in between. Rows that both
exports hold equally often cancel out; what is left was removed, added or, where one key has rows on both sides, changed.

Both exports go through one aggregate over all columns. Equal rows are counted before the shuffle, so a row that makes up
a third of an export is one row per task there.

Awkward input: missing values are equal to each other; rows without a key are added or removed, never changed; columns are
matched by name, and both exports must have the same ones; two empty exports have no difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.joins import HOT_SPLIT_ROWS, hot_keys, split_hot_join
from ledgerlens.schema import quote
from ledgerlens.session import materialize


def bag_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """The columns of ``old``, ``removed`` and ``added``: by how many copies a row is rarer or more frequent in ``new``.

    ``removed`` counts are those of ``old EXCEPT ALL new``, ``added`` those of ``new EXCEPT ALL old``; rows equally frequent are left out."""
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"Exports differ in their columns: {sorted(set(old.columns) ^ set(new.columns))}")
    names = [f"_c{i}" for i in range(len(old.columns))]
    sides = [df.select(*[F.col(quote(c)).alias(n) for c, n in zip(old.columns, names)], F.lit(step).alias("_step"))
             for df, step in ((old, -1), (new, 1))]
    net = sides[0].unionByName(sides[1]).groupBy(*names).agg(F.sum("_step").alias("_net")).where("_net != 0")
    return net.select(*[F.col(n).alias(c) for n, c in zip(names, old.columns)],
                      F.greatest(-F.col("_net"), F.lit(0).cast("bigint")).alias("removed"),
                      F.greatest("_net", F.lit(0).cast("bigint")).alias("added"))


def export_difference(old: DataFrame, new: DataFrame, key: str = "s_no", split_rows: int = HOT_SPLIT_ROWS) -> DataFrame:
    """:func:`bag_difference` with ``kind``: ``changed`` where rows of the same ``key`` were both removed and added, else
    ``removed`` or ``added``."""
    rows = materialize(bag_difference(old, new), "export_difference").withColumn("_key", F.col(quote(key)))
    sides = materialize(rows.where("_key IS NOT NULL").groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), ((F.sum("removed") > 0) & (F.sum("added") > 0)).alias("_both")), "export_keys")
    joined = split_hot_join(rows, sides.select("_key", "_both"), "_key", hot_keys(sides, "_key", split_rows=split_rows))
    kind = F.when(F.coalesce("_both", F.lit(False)), "changed").when(F.col("added") > 0, "added").otherwise("removed")
    return joined.withColumn("kind", kind).drop("_key", "_both")
