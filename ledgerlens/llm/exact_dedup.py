"""Exact de-duplication by 128-bit content hash with byte comparison.

Documents are grouped by (MD5, text): the hash spreads the rows and decides
nearly every comparison, the text in the key compares the bytes, so two
different texts that share a hash stay apart. The aggregation combines copies
inside each map task, so a group holding a third of all rows sends one row per
task. One text crosses the shuffle per task and class; what joins back to the
documents is the narrow (hash, digest, id, count) row.

Behaviour on awkward input:

* null text is the empty text; every empty document is one group;
* rows that repeat both id and text are the same document and get the same
  verdict; :func:`drop_copies` returns one of them;
* a null id loses to any id; a group of null ids only has a null ``keep_id``
  and its rows count as kept;
* an empty table gives an empty result;
* other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import text_or_empty


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256``. ``keep`` chooses the id that stays: "smallest" or
    "largest"."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    text = text_or_empty(docs[f"`{text_col}`"])
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), text.alias("text"),
                       F.unhex(F.md5(text.cast("binary"))).alias("hash"))
    stays = (F.min if keep == "smallest" else F.max)("doc_id")
    classes = (rows.groupBy("hash", "text")
               .agg(stays.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               # The digest names the class inside its hash in the join back.
               .select("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                       "keep_id", "group_size"))
    members = rows.select("doc_id", "hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    # Sort-merge, both sides shuffled on the join keys: adaptive execution
    # splits the member side of a hot group over several tasks.
    return (members.hint("merge").join(classes, ["hash", "digest"])
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of ``docs`` for each distinct text, that of the kept id, with all its columns (of rows that repeat
    both, any one). One shuffle carries the texts, combined in the map tasks first."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    id_, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col], text.isNull().alias("__no_text"))
    if keep == "smallest":
        chosen = F.min_by("__row", F.struct(F.col("__id").isNull(), F.col("__id")))
    else:
        chosen = F.max_by("__row", F.struct(F.col("__id").isNotNull(), F.col("__id")))
    rows = docs.select(F.unhex(F.md5(text_or_empty(text).cast("binary"))).alias("__hash"), text_or_empty(text).alias("__text"),
                       id_.alias("__id"), others.alias("__row"))
    kept = rows.groupBy("__hash", "__text").agg(chosen.alias("__row"))
    return kept.select(*[F.when(~F.col("__row.__no_text"), F.col("__text")).alias(c) if c == text_col
                         else F.col("__row")[c].alias(c) for c in docs.columns])
