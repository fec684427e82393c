"""Merkle manifest of a table, with a proof for every row.

A row's leaf is the SHA-256 of its fields, each with its length. Leaves form one
tree per source, in id order, and the sources' roots one tree above them; a node
is the hash of up to 16 consecutive ones (hex digests joined), and a level is
reduced while it has several nodes.

Superblocks of ``ARITY ** LEVELS`` (4,096) consecutive nodes are the unit of work. Going
up, each superblock is reduced to one node, which is a row of the next tier, until
a tree is a single node. Going down, the nodes of a superblock and the one row
of outer nodes that its proofs need (the siblings met above it) are cogrouped by
superblock in ``applyInPandas``, which reduces the block again, joins the proofs
and folds them; so a tier's outer nodes come from the tier above, and no row
carries its whole proof through a shuffle. A superblock has at most 4,096 small
rows whatever the size of its source.

Places in a tree come from a range partitioning by (source, id): each task numbers its
own rows, and the number of rows before a task's share of a source is added up
over one row for each task and source. No source is sorted or counted in one task.

Behaviour on awkward input: a null field is hashed as ``-``; a null source is a
source of its own and comes first, a null id comes first in its source and is not
tampered with; rows with one id are ordered by their leaf, equal rows are
neighbours with equal leaves; empty and long texts are hashed whole; an
empty table gives an empty result; only the five columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import ascii_lower, stored

#: Children of a node; levels that a superblock reduces.
ARITY, LEVELS = 16, 3
#: A row is tampered with where this divides its id's hash.
TAMPERED = 5


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    written = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")))
               for f in fields]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` in ranges of ``group`` and ``order``, with ``part`` and ``local``: their task and place there within ``group``."""
    schema = rows.withColumns({"part": F.lit(0), "local": F.lit(0).cast("bigint")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(group)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new = np.concatenate([[keys[0].as_py() != last], codes[1:] != codes[:-1]])
            at = np.arange(n)
            local = at - np.maximum.accumulate(np.where(new, at, 0))
            if not new[0]:  # the batch goes on with the group before
                local[:new.argmax() if new.any() else n] += seen
            last, seen = keys[n - 1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local)],
                                             [*batch.schema.names, "part", "local"])
    return rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def shares(rows: DataFrame, group: str) -> DataFrame:
    """``part, group, before, size``: rows of the group in earlier tasks, in all. One row for each task and group."""
    counts = rows.groupBy("part", group).agg(F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy(group)
    return counts.select("part", group, (F.sum("rows").over(own.orderBy("part")) - F.col("rows")).alias("before"),
                         F.sum("rows").over(own).alias("size"))


def levels_left(size: int, most: int) -> int:
    """Levels of reduction from so many nodes to one, ``most`` at most."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def reduce_block(nodes: list[str], levels: int) -> list[list[str]]:
    """The block's levels, its nodes first; the last one has a single node."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sha("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Digests left and right of node ``i``'s path at every level of its block but the last."""
    out = []
    for level in levels[:-1]:
        begin = i // ARITY * ARITY
        out.append(("".join(level[begin:i]), "".join(level[i + 1:begin + ARITY])))
        i //= ARITY
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = sha(left + node + right)
    return node


def tiers(nodes: DataFrame, name: str, most: int = LEVELS) -> list[DataFrame]:
    """Tables ``tree, place, size, digest`` from ``nodes`` up to one node per tree."""
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        size = int(block["size"].iloc[0])
        top = reduce_block(block["digest"].tolist(), levels_left(size, most))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "size": [-(-size // ARITY ** most)], "digest": [top]})
    found = [nodes]
    while not found[-1].where("size > 1").isEmpty():
        blocks = _blocks(found[-1].select("tree", "place", "size", "digest"), most)
        found.append(stored(blocks.applyInPandas(run, "tree bigint, place bigint, size bigint, digest string"), f"{name}-tier"))
    return found


def _outer(rows: pd.DataFrame) -> list[tuple[str, str]]:
    """The one row of outer nodes as pairs; none above a tree's only superblock."""
    if not len(rows):
        return []
    return list(zip(rows["lefts"].iloc[0], rows["rights"].iloc[0]))


def _blocks(nodes: DataFrame, most: int):
    return nodes.withColumn("block", F.expr(f"place div {ARITY ** most}")).groupBy("tree", "block")


def _below(outer: DataFrame, most: int) -> DataFrame:
    """A tier's nodes as rows for the superblocks of the tier below: node ``place`` stands above block ``place``."""
    return outer.withColumn("place", F.col("place") * ARITY ** most)


def descend(found: list[DataFrame], top: DataFrame, name: str, most: int = LEVELS) -> DataFrame:
    """``tree, place, lefts, rights``: the outer nodes, bottom first, of the nodes of ``found[1]``, which are the superblocks of
    ``found[0]``. ``top``: those of each tree's last node."""
    def run(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        levels = reduce_block(block["digest"].tolist(), levels_left(int(block["size"].iloc[0]), most))
        paths = [siblings(levels, i) + _outer(above) for i in range(len(block))]
        return pd.DataFrame({"tree": key[0], "place": block["place"].to_numpy(),
                             "lefts": [[a for a, _ in p] for p in paths], "rights": [[b for _, b in p] for p in paths]})
    outer = top
    for tier in reversed(found[1:-1]):
        groups = _blocks(tier.select("tree", "place", "size", "digest"), most).cogroup(_blocks(_below(outer, most), most))
        outer = stored(groups.applyInPandas(run, "tree bigint, place bigint, lefts array<string>, rights array<string>"), f"{name}-outer")
    return outer


def prove(leaves: DataFrame, outer: DataFrame, most: int = LEVELS) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root`` of ``leaves``: ``tree, place, size, id, digest, tampered`` (null:
    as it was). ``outer``: one row per superblock, with its ``subroot`` and ``root``."""
    def run(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        digests, outer = block["digest"].tolist(), _outer(above)
        levels = reduce_block(digests, levels_left(int(block["size"].iloc[0]), most))
        rest = "".join(left + right for left, right in outer)
        proofs, folded = [], []
        for i, (digest, tampered) in enumerate(zip(digests, block["tampered"])):
            path = siblings(levels, i)
            proofs.append(sha("".join(left + right for left, right in path) + rest))
            folded.append(fold(fold(tampered if isinstance(tampered, str) else digest, path), outer))
        return pd.DataFrame({"id": block["id"].to_numpy(), "leaf": digests, "subroot": above["subroot"].iloc[0],
                             "root": above["root"].iloc[0], "proof_sha256": proofs, "folded_root": folded})
    return _blocks(leaves, most).cogroup(_blocks(_below(outer, most), most)).applyInPandas(
        run, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = ("lang", "n_chars", "text"),
             text_col: str = "text", most: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    cols = {name: docs[f"`{name}`"] for name in (id_col, source_col, *fields)}
    tamper = F.pmod(F.crc32(cols[id_col].cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    changed = [ascii_lower(c) if name == text_col else c for name, c in cols.items()]
    rows = stored(docs.select(
        cols[source_col].alias("source"), cols[id_col].alias("doc_id"), leaf(*cols.values()).alias("digest"),
        F.when(tamper, leaf(*changed)).alias("tampered"), F.monotonically_increasing_id().alias("row")), "leaves")

    rows = stored(numbered(rows, "source", ["doc_id", "digest", "row"]).drop("row"), "leaves-in-order")
    own = stored(shares(rows, "source"), "source-shares")
    # The sources in order are the leaves of the upper tree; a source's place there names its own tree.
    forest = F.lit(0).cast("bigint").alias("forest")
    ranked = stored(numbered(own.groupBy("source").agg(F.max("size").alias("rows")).select(forest, "source", "rows"), "forest", ["source"]),
                    "sources-in-order")
    trees = stored(ranked.join(shares(ranked, "forest"), ["part", "forest"]).select(
        F.col("source").alias("of"), (F.col("before") + F.col("local")).alias("tree"), F.col("size").alias("trees")), "trees")
    starts = own.join(trees, own["source"].eqNullSafe(trees["of"])).select(
        F.col("part").alias("in_part"), "of", "before", "size", "tree")
    leaves = stored(rows.join(starts, (rows["part"] == starts["in_part"]) & rows["source"].eqNullSafe(starts["of"])).select(
        "tree", (F.col("before") + F.col("local")).alias("place"), "size", F.col("doc_id").cast("string").alias("id"), "digest",
        "tampered"), "placed-leaves")

    lower = tiers(leaves, "source", most)
    roots = lower[-1].select("tree", F.col("digest").alias("subroot"))
    upper = tiers(stored(roots.join(trees, "tree").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("size"),
        F.col("subroot").alias("digest")), "subroots"), "upper", most)
    # Outer nodes of the upper tree's leaves: what each source's root meets on its way up.
    none = F.array().cast("array<string>")
    summit = upper[-1].select("tree", "place", none.alias("lefts"), none.alias("rights"))
    met = descend([upper[0], *upper], summit, "upper", most).select(
        F.col("place").alias("tree"), F.lit(0).cast("bigint").alias("place"), "lefts", "rights")
    summit = F.broadcast(upper[-1].select(F.col("tree").alias("forest"), F.col("digest").alias("root")))  # one row
    known = roots.withColumn("forest", forest).join(summit, "forest").select("tree", "subroot", "root")
    outer = descend(lower, met, "source", most).join(known, "tree")
    return prove(leaves, outer, most).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
