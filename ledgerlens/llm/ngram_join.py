"""N-gram Jaccard join with prefix filters under several global token orders.

Two texts whose shingle sets have Jaccard similarity t or more share a token
among the first ``n - ceil(t n) + 1`` of each set, whichever global order the
tokens are put in. Three orders are used: rarest first, and two by hashes of
their own. Candidates come from the first order's postings; a pair must share a
prefix token under both other orders too before its sets are compared exactly.

Rarest first needs every token's document frequency. Tokens whose hash falls in
a fixed share of the hash range, twice that of a prefix, stand before all
others in the order, so only they are counted (exactly, over all documents) and
shuffled; a set too small to fill its prefix from them adds its next hashes. A
document with enough tokens that nobody else has needs no further look: its
prefix is settled by the counts alone. Common passages lie at the end of the
order, outside nearly every prefix.

Rows with the same set are one class from the start. Within a posting list
classes are first compared with a pivot of the list, not with each other, and
what is linked becomes one component; lists within one component are passed
over. What is left is compared by the differences from the list's pivot, with
a prefix filter of their own (:meth:`NgramJoin._remaining_pairs`): near copies have most
tokens in common, their differences hardly any. A large group of near copies so
costs comparisons about in proportion to its size and its links, and no link
between components is missed.

Behaviour on awkward input: null and empty texts, and white space only, have
no shingles and are linked with nothing, a component each; rows that repeat
are in one class; a null id takes the component of its class, or null where
the class has no id; rows that share an id but not their text are judged by
their text; long texts are read whole; an empty table gives an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import slices
from ledgerlens.llm.components import components
from ledgerlens.llm.shingles import mixed, shingle_sets
from ledgerlens.llm.tables import arrow_rows, stored

#: log2 of the bits that mark ids (half a megabyte).
ID_BITS = 22
#: Hash orders after the first order.
HASH_ORDERS = (1, 2)
#: Share of the tokens that come first in the first order, in prefixes.
COUNTED = 2
#: Pairs of whole sets that a task compares at a time.
PAIRS_AT_ONCE = 200
#: Rounds in which lists are compared with a pivot, before all remaining pairs are.
PIVOT_ROUNDS = 2


def prefix_size(n, num: int, den: int):
    """n - ceil(num / den * n) + 1 for sets that are not empty (arrays or columns of integers)."""
    if isinstance(n, Column):
        return n - F.floor((n * num + (den - 1)) / den).cast("bigint") + 1
    return np.where(n > 0, n - -(-n * num // den) + 1, 0)


def counted_below(num: int, den: int) -> int:
    """Hashes below this belong to the counted share."""
    return min((1 << 64) - 1, COUNTED * (den - num) * (1 << 64) // den)


def hash_prefixes(hashes: np.ndarray, offsets: np.ndarray, num: int, den: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit tokens, offsets): the prefix of each set under the order of another hash."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    other = mixed(hashes, 100 + order)
    placed = np.lexsort((other, doc))
    length = prefix_size(n, num, den)
    kept = placed[np.arange(len(hashes)) - offsets[:-1][doc] < length[doc]]
    return (other[kept] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.concatenate([[0], np.cumsum(length)])


def first_tokens(hashes: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, offsets, late): the counted tokens of each set, or its prefix size of smallest hashes if they are
    fewer; ``late`` is the place in the order of a token that is not counted, else -1."""
    n = np.diff(offsets)
    counts = np.concatenate([[0], np.cumsum(hashes < np.uint64(counted_below(num, den)))])
    m = counts[offsets[1:]] - counts[offsets[:-1]]  # hashes ascend, so these are the first
    length = np.maximum(m, prefix_size(n, num, den))
    doc = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(hashes)) - offsets[:-1][doc]
    at = np.flatnonzero(rank < length[doc])
    late = np.where(rank[at] < m[doc[at]], -1, rank[at])
    return at, np.concatenate([[0], np.cumsum(length)]), late


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(offsets.astype(np.int32), values)


def _digests(hashes: np.ndarray, offsets: np.ndarray, salt: int) -> list[np.ndarray]:
    """Two 64-bit sums of each set's mixed hashes."""
    out = []
    for which in (0, 1):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes, 10 + 2 * salt + which), dtype=np.uint64)])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out


def marked(ids: DataFrame, column: str = "doc_id", bits: int = ID_BITS) -> Column:
    """A condition on ``column`` that holds for every id of ``ids`` (one column, doc_id) and few others: a bit map
    of hashed ids, ``2 ** bits`` bits whatever the input."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = dict(ids.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int")).alias("bit"))
                 .groupBy("word").agg(F.bit_or("bit")).collect())
    slot = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    held = F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(1 << bits - 6))), ",").cast("array<bigint>")
    return F.getbit(F.get(held, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1


class NgramJoin:
    """The join of one table: ``k``-word shingles, similarity of at least ``num / den``. A node is a class of equal
    sets, named by its digest."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < num <= den or k < 1:
            raise ValueError("need 0 < num <= den and k >= 1")
        self.k, self.num, self.den, self.salt = k, num, den, 0
        self.docs = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))

    def signatures(self) -> DataFrame:
        """``doc_id, n, m, node, check``: set size, counted tokens, digest."""
        k, num, den, salt = self.k, self.num, self.den, self.salt

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                hashes, offsets = shingle_sets(batch.column("text"), k)
                counted = np.concatenate([[0], np.cumsum(hashes < np.uint64(counted_below(num, den)))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counted[offsets[1:]] - counted[offsets[:-1]]),
                     *map(pa.array, _digests(hashes, offsets, salt))], ["doc_id", "n", "m", "node", "check"])
        return self.docs.mapInArrow(run, "doc_id bigint, n bigint, m bigint, node bigint, check bigint")

    def _texts_of(self, ids: DataFrame) -> DataFrame:
        """The rows whose id is in ``ids`` (doc_id). A bit map of fixed size keeps most others out of the shuffle."""
        return self.docs.where(F.col("doc_id").isNotNull() & marked(ids)).join(ids, "doc_id", "left_semi")

    def postings(self, signed: DataFrame, classes: DataFrame) -> DataFrame:
        """``token, node, late`` of one row of every class, that of its smallest id."""
        k, num, den, salt = self.k, self.num, self.den, self.salt

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                hashes, offsets = shingle_sets(batch.column("text"), k)
                at, ends, late = first_tokens(hashes, offsets, num, den)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(_digests(hashes, offsets, salt)[0][doc]),
                     pa.array(late.astype(np.int32)), batch.column("doc_id").take(pa.array(doc))],
                    ["token", "node", "late", "doc_id"])
        schema = "token bigint, node bigint, late int, doc_id bigint"
        # Rows that are not their class's first one go, and ids on several rows are looked at by themselves.
        ids = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("rows"), F.min("node").alias("node"))
        ids = ids.join(classes.select("node", "rep"), "node")
        odd = stored(ids.where("rows > 1 OR rep != doc_id").select("doc_id", (F.col("rows") > 1).alias("repeats")), "not-first")
        odd_ids = odd.select("doc_id")
        maybe = marked(odd_ids)
        known = self.docs.where("doc_id IS NOT NULL")
        plain = known.where(~maybe).unionAll(known.where(maybe).join(odd_ids, "doc_id", "left_anti"))
        rows = plain.mapInArrow(run, schema)
        again = odd.where("repeats").select("doc_id")
        if not again.isEmpty():
            more = self._texts_of(again).mapInArrow(run, schema).join(
                classes.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"], "left_semi")
            rows = rows.unionAll(more.select("token", "node", "late", "doc_id").dropDuplicates(["token", "node"]))
        return rows.select("token", "node", "late")

    def prefixes(self, signed: DataFrame, classes: DataFrame) -> DataFrame:
        """``token, node, n, pos, alone``: tokens of the first order's prefixes that more than one class has;
        ``alone`` counts the class's tokens that no other has."""
        rows = self.postings(signed, classes)
        shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        rows = stored(rows.join(shared, "token"), "shared-tokens")
        own = Window.partitionBy("node")
        early = F.col("late") < 0
        rows = rows.join(classes.select("node", "n", "m"), "node")
        rows = rows.withColumn("alone", F.col("m") - F.count(F.when(early, 1)).over(own))  # counted tokens of this class only
        rows = rows.withColumn("rank", F.row_number().over(own.orderBy(F.when(early, F.lit(0)).otherwise(F.lit(1)), "df", "token")))
        rows = rows.withColumn("pos", F.when(early, F.col("alone") + F.col("rank") - 1).otherwise(F.col("late")))
        return rows.where(F.col("pos") < prefix_size(F.col("n"), self.num, self.den)).select("token", "node", "n", "pos", "alone")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``node, n, tokens, second, third``: sorted hashes and the other orders' prefixes of the rows with the ids in
        ``wanted`` (doc_id)."""
        k, num, den, salt = self.k, self.num, self.den, self.salt

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                hashes, offsets = shingle_sets(batch.column("text"), k)
                raw = hashes.astype("<u8").tobytes()
                tokens = pa.array([raw[8 * a:8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
                others = [_lists(*hash_prefixes(hashes, offsets, num, den, order)) for order in HASH_ORDERS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(hashes, offsets, salt)[0]), pa.array(np.diff(offsets)), tokens, *others],
                    ["node", "n", "tokens", "second", "third"])
        return self._texts_of(wanted).mapInArrow(run, "node bigint, n bigint, tokens binary, second array<int>, third array<int>")

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar: the other orders' filters, then the sets themselves."""
        num, den = self.num, self.den

        def side(name: str, *columns: str) -> DataFrame:
            return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
        near = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
        passed = (pairs.join(side("a", "n", "second", "third"), "a").join(side("b", "n", "second", "third"), "b")
                  .where(near & F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
                  .select("a", "b").distinct())
        passed = stored(passed, "candidates")
        whole = (passed.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
                 .select("a", "b", "tokens_a", "tokens_b"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                same = []
                for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b")):
                    x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")  # merges the two sorted runs
                    shared = int((both[1:] == both[:-1]).sum())
                    same.append(shared * den >= (len(both) - shared) * num)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(same, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
        return whole.mapInArrow(run, "a bigint, b bigint").distinct()

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(signatures; ``n, node, check, label``: the smallest id of the component of every class)."""
        while True:
            signed = stored(self.signatures(), "signatures")
            classes = stored(signed.where("n > 0").groupBy("n", "node", "check").agg(
                F.min("doc_id").alias("rep"), F.first("m").alias("m")), "classes")
            if classes.groupBy("node").count().where("count > 1").isEmpty():
                break
            self.salt += 1  # two classes with one name: name them anew
        named = classes.where("rep IS NOT NULL")
        postings = stored(self.prefixes(signed, named), "prefixes")
        lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", self._central()).alias("pivot")).where("size > 1")
        shared = stored(postings.join(lists, "token"), "postings")
        wanted = stored(shared.select("node").distinct().join(named, "node").select(
            F.col("rep").alias("doc_id")).distinct(), "wanted")
        sets = stored(self.sets(wanted), "sets")

        edges, labels = None, None
        for i in range(PIVOT_ROUNDS + 1):
            rows = shared if labels is None else stored(self._open(shared, labels), "open")
            if labels is not None and rows.isEmpty():
                break
            if i < PIVOT_ROUNDS:
                pairs = self._pivot_pairs(rows)
            else:
                with arrow_rows(self.docs.sparkSession, PAIRS_AT_ONCE):
                    apart = stored(self._differences(self._placed(rows, sets, labels), sets), "differences")
                edges = edges.unionAll(stored(self._pivot_links(apart), "pivot-links"))
                labels = components(edges)
                pairs = self._remaining_pairs(apart, labels)
            with arrow_rows(self.docs.sparkSession, PAIRS_AT_ONCE):
                found = stored(self.links(pairs, sets), "links")
            edges = found if edges is None else edges.unionAll(found)
            if i and found.isEmpty():
                continue
            labels = components(edges)
        least = labels.join(named.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
        least = stored(labels.join(least, "label").select("node", "least"), "component-ids")
        out = classes.select("n", "node", "check", "rep").join(least, "node", "left")
        return signed, out.select("n", "node", "check", F.coalesce("least", "rep").alias("label"))

    @staticmethod
    def _central() -> Column:
        """Least for the class of a list with the fewest tokens of its own: of near copies with edits each, the text
        they were made from, to which all are nearer than to each other. Ties by a hash, another one in every list."""
        return F.col("alone") * (1 << 32) + F.xxhash64("token", "node").bitwiseAND((1 << 32) - 1)

    @classmethod
    def _open(cls, shared: DataFrame, labels: DataFrame) -> DataFrame:
        """Postings, with the label of each class, of the lists that hold several components; ``main`` is the most
        frequent one, the pivot its central class."""
        known = shared.select("token", "node", "n", "pos", "alone").join(labels, "node", "left")
        known = stored(known.withColumn("label", F.coalesce("label", "node")), "labelled")
        by_label = known.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", cls._central()).alias("central"))
        lists = by_label.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", "size").alias("main"),
                                              F.max_by("central", "size").alias("pivot")).where("labels > 1").drop("labels")
        return known.join(lists, "token")

    @staticmethod
    def _pivot_pairs(rows: DataFrame) -> DataFrame:
        """Each class with one pivot of its lists, that of its longest list; in later rounds with one of any list, only
        where their components differ."""
        hashed = F.xxhash64("token", "node").bitwiseAND((1 << 32) - 1)
        if "label" in rows.columns:
            rows, chosen = rows.where("label != main"), F.max_by("pivot", hashed)
        else:
            rows, chosen = rows.where("node != pivot"), F.max_by("pivot", F.col("size") * (1 << 32) + hashed)
        return rows.groupBy("node").agg(chosen.alias("pivot")).select(
            F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    def _placed(self, rows: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """Postings as in :meth:`_open`, but of the open classes alone and by the counts of all their tokens. Any pair
        still to be found is among them, and rarest first is a global order of their tokens too; with every token
        counted, a class's own ones push its shared ones as far back as they belong."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for node, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    tokens = np.frombuffer(raw, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), node)), pa.array(np.full(len(tokens), n))],
                                                     ["token", "node", "n"])
        nodes = sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", "n", "tokens").dropDuplicates(["node"])
        tokens = stored(nodes.mapInArrow(run, "token bigint, node bigint, n bigint"), "open-tokens")
        shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        own = Window.partitionBy("node")
        placed = tokens.join(shared, "token").withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own))
        placed = placed.withColumn("pos", F.col("alone") + F.row_number().over(own.orderBy("df", "token")) - 1)
        placed = placed.where(F.col("pos") < prefix_size(F.col("n"), self.num, self.den)).select("token", "node", "n", "pos", "alone")
        return self._open(placed, labels)

    def _differences(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """``pivot, node, n, n_pivot, d, token``: the ``d`` tokens that a class or the pivot of one of its lists has and the
        other has not."""
        members = rows.select("node", "pivot").distinct()
        whole = members.join(sets.select("node", "n", "tokens"), "node").join(
            sets.select(F.col("node").alias("pivot"), F.col("n").alias("n_pivot"), F.col("tokens").alias("tokens_pivot")), "pivot").select(
            "pivot", "node", "n", "n_pivot", "tokens", "tokens_pivot")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for x, y in zip(batch.column("tokens"), batch.column("tokens_pivot")):
                    both = np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")])
                    both.sort(kind="stable")  # merges the two sorted runs
                    twice = np.zeros(len(both) + 1, bool)
                    twice[1:-1] = both[1:] == both[:-1]
                    found.append(both[~(twice[1:] | twice[:-1])].view(np.int64))
                counts = np.array([len(f) for f in found], np.int64)
                at = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in ("pivot", "node", "n", "n_pivot")), pa.array(np.repeat(counts, counts)),
                     pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["pivot", "node", "n", "n_pivot", "d", "token"])
        return whole.mapInArrow(run, "pivot bigint, node bigint, n bigint, n_pivot bigint, d bigint, token bigint")

    def _pivot_links(self, apart: DataFrame) -> DataFrame:
        """Each class with each pivot of its lists that it is similar to: sets with ``d`` tokens not in both are if
        ``(den + num) d <= (den - num) (n + n_pivot)``."""
        num, den = self.num, self.den
        similar = apart.where(F.col("d") * (den + num) <= (F.col("n") + F.col("n_pivot")) * (den - num))
        return similar.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    def _remaining_pairs(self, apart: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs of a list that may still be similar though their components differ, by their differences from the pivot.

        What x and y do not share, their differences Dx and Dy do not share either, so they are similar if and only
        if ``|Dx| + |Dy| - 2 |Dx & Dy| <= H = (den - num) / (den + num) (n_x + n_y)``. Where ``|Dx| + |Dy| <= H`` both are similar
        to the pivot (the one with the smaller difference; the other one's is at most H of its own pair with it), so they are in
        one component by now. Otherwise the differences share tokens, and a prefix filter on them finds the pair: tokens that no
        other component has come first, then the rarest. Near copies share most of their tokens, but their differences
        consist of edits of their own, so that few of them meet, however many there are."""
        num, den = self.num, self.den
        known = stored(apart.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled-differences")
        shared = known.groupBy("pivot", "token").agg(
            F.count(F.lit(1)).alias("df"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").drop("least", "most")
        own = Window.partitionBy("pivot", "node")
        placed = known.join(shared, ["pivot", "token"]).withColumn("alone", F.col("d") - F.count(F.lit(1)).over(own))
        placed = placed.withColumn("pos", F.col("alone") + F.row_number().over(own.orderBy("df", "token")) - 1)
        # H is at most (den - num) / num n for a set and any that is similar to it.
        most = F.col("n") * (den - num)
        placed = stored(placed.where(2 * num * F.col("pos") <= num * F.col("d") + most).select(
            "pivot", "token", "node", "n", "d", "pos", "label", (2 * num * F.col("pos") <= most).alias("early")), "placed-differences")

        def side(rows: DataFrame, name: str) -> DataFrame:
            return rows.select("pivot", "token", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "d", "pos", "label")])
        x, y = side(placed, "x"), side(placed.where("early"), "y")  # x has the larger difference
        room = F.least(F.col("d_x") - F.col("pos_x"), F.col("d_y") - F.col("pos_y"))
        size = F.col("n_x") + F.col("n_y")
        meet = ((x["pivot"] == y["pivot"]) & (x["token"] == y["token"]) & (F.col("label_x") != F.col("label_y"))
                & ((F.col("d_x") > F.col("d_y")) | (F.col("d_x") == F.col("d_y")) & (F.col("node_x") > F.col("node_y")))
                & (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num)
                & (2 * room * (den + num) >= (F.col("d_x") + F.col("d_y")) * (den + num) - size * (den - num)))
        return x.join(y, meet).select(
            F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def join_components(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest id reachable by links, itself included."""
    signed, classes = NgramJoin(docs, k, num, den, id_col, text_col).classes()
    rows = signed.select("doc_id", "n", "node", "check").where("n > 0").join(classes, ["n", "node", "check"])
    alone = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id")).unionAll(alone)


def drop_near_copies(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; rows without an id stay.

    Only the ids that go are joined, and of the texts only those the bit map marks are shuffled for it."""
    found = join_components(docs, k, num, den, id_col, text_col).where("doc_id IS NOT NULL AND component_id IS NOT NULL")
    goes = stored(found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("goes")).where("goes")
                  .select("doc_id"), "near-copies")
    slot = docs.withColumn("__near_id", docs[f"`{id_col}`"].cast("bigint"))
    maybe = marked(goes, "__near_id")
    stays = slot.where(F.col("__near_id").isNull() | ~maybe)
    looked = slot.where(F.col("__near_id").isNotNull() & maybe).join(
        goes.select(F.col("doc_id").alias("__near_gone")), F.col("__near_id") == F.col("__near_gone"), "left_anti")
    return stays.unionAll(looked).drop("__near_id")
