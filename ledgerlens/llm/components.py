"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``edges`` (a, b): the smallest node reachable.

    Each round gives a node the smallest label among its own and its neighbours', then follows that label's
    own label, so the distance covered doubles. Labels are written to the shared folder every round; the loop ends
    with the first round that changes none. Hubs are combined before the shuffle (minimum) and split in the joins; a
    side that its stored size shows to be small is broadcast by the planner."""
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node != other").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("least")).select(
        "node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(
            F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = stored(lower.join(jump, "label").select("node", F.least("label", "root").alias("label"),
                                                                    (F.least("label", "root") < F.col("old")).alias("changed")), "labels")
        moved = new.where("changed").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
