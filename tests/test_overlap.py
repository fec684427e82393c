"""Differences of exports against counters of rows."""

import random
from collections import Counter

import pytest

from ledgerlens.operators.overlap import bag_difference, export_difference

DDL = "s_no long, `Remarks.raw` string, withdrawal double, removed string"


def export(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "b"]), rng.choice([None, 1.0, 2.0]), "x") for _ in range(n)]
    return rows + [(7, "hot", 1.0, "x")] * (n // 2 + seed)


def test_bag_difference_is_except_all_both_ways(spark):
    old, new = export(1, 300), export(2, 280)
    a, b = (spark.createDataFrame(rows, DDL).drop("removed") for rows in (old, new))
    got = bag_difference(a, b).collect()
    lost, won = (Counter(r[:3] for r in x) - Counter(r[:3] for r in y) for x, y in ((old, new), (new, old)))
    assert {tuple(r)[:3]: (r["removed"], r["added"]) for r in got} == {k: (lost[k], won[k]) for k in lost | won}
    for one, other, counts in ((a, b, lost), (b, a, won)):
        assert Counter(map(tuple, one.exceptAll(other).collect())) == counts
    assert bag_difference(a, a).collect() == [] and bag_difference(a.limit(0), b.limit(0)).collect() == []
    with pytest.raises(ValueError):
        bag_difference(a, b.withColumnRenamed("s_no", "no"))


@pytest.mark.parametrize("split_rows", [1_000_000, 2])
def test_kinds(spark, split_rows):
    old, new = export(3, 60), export(4, 60)
    a, b = (spark.createDataFrame(rows, DDL).drop("removed") for rows in (old, new))
    got = export_difference(a, b, split_rows=split_rows)
    assert set(got.columns) == {*a.columns, "removed", "added", "kind"}
    lost, won = (Counter(r[:3] for r in x) - Counter(r[:3] for r in y) for x, y in ((old, new), (new, old)))
    both = {k[0] for k in lost} & {k[0] for k in won} - {None}
    want = {k: "changed" if k[0] in both else "added" if won[k] else "removed" for k in lost | won}
    assert {(r["s_no"], r["Remarks.raw"], r["withdrawal"]): r["kind"] for r in got.collect()} == want


def test_equal_rows_are_counted_before_the_shuffle(spark):
    a = spark.createDataFrame(export(1, 20), DDL).drop("removed")
    plan = bag_difference(a, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_sum" in plan
