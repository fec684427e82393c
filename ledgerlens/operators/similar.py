"""Groups of similar keys: similarity join by deletion neighbourhoods, then components.

Two keys are similar if one or two letters inserted, deleted or replaced make one
the other (Levenshtein distance of at most ``edits``). Every key is written with each
choice of up to ``edits`` letters left out, and what is left, with the places, says how
two keys that share it are related:

* the same places left out: the keys differ by replacements there;
* one letter left out each, at any places (``edits`` = 2): a deletion and an insertion;
* nothing left out of one of them: the other one has the letters more;
* two letters left out of one, one of the other, where one place is the same in both: a
  replacement there and a deletion.

In all but the last case every two keys of such a bucket are similar, in the last
each key with two letters left out is similar to each with one. So a bucket is a
star around one of its keys: its links are as many as its rows, however many keys
share it, and no two keys are ever compared. Buckets are keyed by a 128-bit
hash, and components of the stars are found by passing on the smallest key.

For one edit the neighbourhoods are not shuffled. An edit leaves the first or the second half of the
longer key as it is, so two similar keys meet where keys are dealt by halves: four rows a key, for its
own length and the next. What is left of a key is written out there, and a sort puts the star's centre first.
Halves that many keys share are dealt by half and rest instead, so no task takes all of one.

Keys shorter than ``least_length`` are similar to nothing but themselves. A key of
n letters has n(n+1)/2+1 rows for two edits, n+2 for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.joins import HOT_SPLIT_ROWS, hot_keys, split_hot_join
from ledgerlens.operators.rules import remark_consensus
from ledgerlens.session import materialize


# Rows of one half (of a cell of halves) that are dealt to one task.
HOT_HALF_ROWS = 200_000
# Cells that the halves are counted in, by hash.
HALF_CELLS = 1 << 16
# Rounds of :func:`groups` that take the smallest key; later ones follow a hash, so a long chain halves too.
ORDERED_ROUNDS = 2


def _left_out(keys: DataFrame) -> DataFrame:
    """``key, rest, places``: each key with up to two letters left out; ``places``: where, from 1, ascending."""
    size = F.length("key")
    one = keys.select("key", F.explode(F.sequence(F.lit(1), size)).alias("p"))
    rest = F.concat(F.substring("key", F.lit(1), F.col("p") - 1), F.substring("key", F.col("p") + 1, size))
    one = one.select("key", rest.alias("rest"), "p")
    # The second letter lies before the first: its place is the same in the key and in what is left.
    two = one.where("p > 1").select("key", "rest", "p", F.explode(F.sequence(F.lit(1), F.col("p") - 1)).alias("q"))
    rest = F.concat(F.substring("rest", F.lit(1), F.col("q") - 1), F.substring("rest", F.col("q") + 1, size))
    return keys.select("key", F.col("key").alias("rest"), F.array().cast("array<int>").alias("places")).unionAll(
        one.select("key", "rest", F.array("p").alias("places"))).unionAll(two.select("key", rest.alias("rest"), F.array("q", "p").alias("places")))


def _links_of_two(keys: DataFrame) -> DataFrame:
    """Links within two edits: every row of the deletion neighbourhood is dealt to its buckets."""
    rows = _left_out(keys)
    out = F.size("places")
    # (kind, the bucket's further key, whether the row may be the centre)
    same = F.struct(F.lit("same").alias("kind"), F.array_join("places", ",").alias("at"), F.lit(True).alias("centre"))
    whole = F.struct(F.lit("whole").alias("kind"), F.lit("").alias("at"), (out == 0).alias("centre"))
    moved = F.when(out == 1, F.struct(F.lit("moved").alias("kind"), F.lit("").alias("at"), F.lit(True).alias("centre")))

    # A letter replaced at r and one more: r counted in the shorter key, whose letter left out it is.
    def mixed(r, centre):
        return F.struct(F.lit("mixed").alias("kind"), r.cast("string").alias("at"), F.lit(centre).alias("centre"))
    roles = [F.when(out > 0, same), whole, moved, F.when(out == 1, mixed(F.get("places", F.lit(0)), True)),
             # Of the places q < p, q is r if the letter at p is the one more; else r is p without the letter at q.
             F.when(out == 2, mixed(F.get("places", F.lit(0)), False)),
             F.when(out == 2, mixed(F.get("places", F.lit(1)) - 1, False))]
    dealt = rows.select("key", "rest", F.explode(F.filter(F.array(*roles), lambda r: r.isNotNull())).alias("role"))
    dealt = dealt.select("key", F.unhex(F.md5(F.concat_ws("\n", "role.kind", "role.at", "rest").cast("binary"))).alias("bucket"),
                         F.col("role.centre").alias("centre")).distinct()
    centres = dealt.where("centre").groupBy("bucket").agg(F.min("key").alias("b"))
    return dealt.join(centres, "bucket").where("key != b").select(F.col("key").alias("a"), "b")


def _halves(keys: DataFrame) -> DataFrame:
    """``key, half, low, high``: the halves a key is dealt by, and the places where a letter is left out there.

    For a longer key of n letters the halves are its first n/2 letters and the others; the letter lies in the other half
    than the shared one. A key is dealt by its own length, and (place 0: no letter left out) by that of keys with a letter more."""
    size = F.length("key")

    def dealt(n, first, low, high):
        cut = F.shiftright(n, 1)
        text = F.substring("key", F.lit(1), cut) if first else F.substring("key", size - (n - cut) + 1, n - cut)
        return F.struct(F.xxhash64(F.lit(first), n, text).alias("half"), low.alias("low"), high.alias("high"))
    cut, none = F.shiftright(size, 1), F.lit(0)
    roles = F.array(dealt(size, True, cut + 1, size), dealt(size, False, F.lit(1), cut),
                    dealt(size + 1, True, none, none), dealt(size + 1, False, none, none))
    return keys.select("key", F.explode(roles).alias("role")).select("key", "role.*").where("low <= high")


def _links_of_one(keys: DataFrame, split_rows: int) -> DataFrame:
    """Links within one edit, see the module's text. Only what is equal as text is linked: hashes deal rows, nothing more."""
    cell = F.pmod("half", F.lit(HALF_CELLS))
    # At most rows / split_rows cells.
    hot = F.broadcast(_halves(keys).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_rows).select("cell"))
    dealt = _halves(keys).withColumn("cell", cell)

    def linked(rows):
        rest = F.concat(F.substring("key", F.lit(1), F.col("place") - 1), F.substring("key", F.col("place") + 1, F.length("key")))
        rows = rows.select("key", "half", F.explode(F.sequence("low", "high")).alias("place")).withColumn(
            "rest", F.when(F.col("place") == 0, F.col("key")).otherwise(rest))
        shared = Window.partitionBy("half", "rest").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, 0)
        alike = Window.partitionBy("half", "rest", "place").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        centre = F.when(F.first("place").over(shared) == 0, F.first("key").over(shared)).otherwise(F.first("key").over(alike))
        return rows.select(F.col("key").alias("a"), centre.alias("b")).where("a != b")
    few = dealt.join(hot, "cell", "left_anti").drop("cell").repartition("half")
    return linked(few).unionAll(linked(dealt.join(hot, "cell", "left_semi").drop("cell")))


def similar_links(keys: DataFrame, edits: int = 1, split_rows: int = HOT_HALF_ROWS) -> DataFrame:
    """``a, b``: links of the distinct keys of ``keys`` (key), of which the components are those of all pairs within
    ``edits`` edits. Every link is such a pair."""
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    links = _links_of_one(keys, split_rows) if edits == 1 else _links_of_two(keys)
    return materialize(links.distinct(), "similar_links")


def groups(links: DataFrame) -> DataFrame:
    """``key, label`` for every end of ``links`` (a, b): the smallest key that links lead to.

    Each round every key joins the first of its neighbours and itself, and the links of keys become links of what they joined,
    until none is left; what a round leaves is smaller, so all rounds cost little more than the first."""
    rounds = []
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if len(rounds) < ORDERED_ROUNDS:
            first = F.least("a", F.min("b"))
        else:
            order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("k"))
            first = F.least(order("a"), F.min(order("b")))["k"]
        joined = materialize(both.groupBy("a").agg(first.alias("to")).select(F.col("a").alias("key"), "to"), "similar_joined")
        rounds.append(joined)
        new = links.join(joined.select(F.col("key").alias("a"), F.col("to").alias("x")), "a").join(
            joined.select(F.col("key").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        links = materialize(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "similar_links")
    if not rounds:
        return links.select(F.col("a").alias("key"), F.col("b").alias("label"))
    # Back from the last round: the label of what a key joined is its own.
    labels = None
    for i in reversed(range(len(rounds))):
        own = rounds[i]
        if labels is not None:
            own = own.join(labels.select(F.col("key").alias("to"), "label"), "to", "left").select("key", F.coalesce("label", "to").alias("label"))
        else:
            own = own.select("key", F.col("to").alias("label"))
        if i == ORDERED_ROUNDS and len(rounds) > i:
            # A group's smallest key is an end of these links, whatever it was called by its hash.
            own = materialize(own, "similar_labels")
            own = own.join(own.groupBy("label").agg(F.min("key").alias("least")), "label").select("key", F.col("least").alias("label"))
        labels = materialize(own, "similar_labels") if i else own
    return labels


def similar_groups(df: DataFrame, key: str = "remark_key", edits: int = 1, least_length: int = 6, out: str = "remark_group",
                   split_rows: int = HOT_SPLIT_ROWS) -> DataFrame:
    """``df`` with ``out``: the smallest key of the row's group of similar keys, its own key where it is similar to
    none; null for rows without a key. Distinct keys are joined; a key with a third of the rows is split in the join back."""
    counts = materialize(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n")), "similar_keys")
    keys = counts.where(F.length("_key") >= least_length).select(F.col("_key").alias("key"))
    found = groups(similar_links(keys, edits)).select(F.col("key").alias("_key"), F.col("label").alias("_group"))
    joined = split_hot_join(df.withColumn("_key", F.col(key)), found, "_key", hot_keys(counts, "_key", split_rows=split_rows))
    return joined.withColumn(out, F.coalesce("_group", "_key")).drop("_key", "_group")


def similar_consensus(df: DataFrame, key: str = "remark_key", value: str = "cleaned_remark", edits: int = 1, least_length: int = 6,
                      split_rows: int = HOT_SPLIT_ROWS) -> DataFrame:
    """Similar rows, not only rows of one key, get one reading: :func:`ledgerlens.operators.rules.remark_consensus` over
    the groups of similar keys, which are kept as ``remark_group``."""
    return remark_consensus(similar_groups(df, key, edits, least_length, split_rows=split_rows), "remark_group", value, split_rows)
