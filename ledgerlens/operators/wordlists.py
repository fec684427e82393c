"""Word lists kept by the user: short forms and category synonyms as tables.

A table has one row per entry, ``(key, value)``; keys are compared without
regard to case. Entries may be chained (a to b, b to c): :func:`closed` follows
every chain to its end by pointer jumping, in as many rounds as the logarithm of
the longest chain, and raises an error where a chain comes back to itself. An
entry whose value is its own key (``fuel`` to ``Fuel``) ends there.

Entries are joined, never compiled into an expression, so a list may have any
length. What is looked up are the distinct texts; rows take their text's result in
a join that splits hot texts (:mod:`ledgerlens.operators.joins`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.joins import HOT_SPLIT_ROWS, hot_keys, split_hot_join
from ledgerlens.session import materialize

#: Names shown in an error message.
SHOWN = 5


def closed(entries: DataFrame) -> DataFrame:
    """``key, value`` with lower-case keys, every value followed to the end of its chain.

    Null or blank keys and null values are no entries; rows that repeat an entry count once. Raises
    ``ValueError`` where one key has several values or a chain is a cycle (with some of the keys)."""
    rows = entries.select(F.lower(F.trim(F.col("key").cast("string"))).alias("key"), F.col("value").cast("string").alias("value"))
    rows = materialize(rows.where("key != '' AND value IS NOT NULL").distinct(), "word_entries")
    unclear = [r["key"] for r in rows.groupBy("key").count().where("count > 1").orderBy("key").limit(SHOWN).collect()]
    if unclear:
        raise ValueError(f"entries with several values: {', '.join(unclear)}")
    known = rows.withColumn("end", F.lower(F.trim("value")))
    known = known.withColumn("hops", (F.col("end") != F.col("key")).cast("int"))
    for _ in range(max(rows.count(), 1).bit_length() + 1):
        onward = known.select(F.col("key").alias("end"), F.col("value").alias("_value"), F.col("end").alias("_end"), F.col("hops").alias("_hops"))
        known = materialize(known.join(onward, "end", "left").select(
            "key", F.coalesce("_value", "value").alias("value"), F.coalesce("_end", "end").alias("end"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.coalesce(F.col("_end") != F.col("end"), F.lit(False)).alias("moved")), "word_chains")
        lost = known.where("end = key AND hops > 0")
        if not lost.isEmpty():
            break
        if known.where("moved").isEmpty():
            return known.select("key", "value")
        known = known.drop("moved")
    else:  # longer than any chain of so many entries
        lost = known
    shown = [r["key"] for r in lost.orderBy(F.desc("hops"), "key").limit(SHOWN).collect()]
    raise ValueError(f"entries that lead back to themselves: {', '.join(shown)}")


def _back(df: DataFrame, found: DataFrame, counts: DataFrame, key: str, split_rows: int) -> DataFrame:
    return split_hot_join(df, found, key, hot_keys(counts, key, split_rows=split_rows))


def canonicalise(df: DataFrame, column: str, synonyms: DataFrame, out: str | None = None,
                 split_rows: int = HOT_SPLIT_ROWS) -> DataFrame:
    """``df`` with ``out`` (``column`` itself by default): the synonym's canonical name, or the value as it is. The
    whole value has to match, without regard to case; null stays null."""
    out = out or column
    keyed = df.withColumn("_word_key", F.lower(F.col(f"`{column}`")))
    counts = materialize(keyed.where("_word_key IS NOT NULL").groupBy("_word_key").agg(F.count(F.lit(1)).alias("n")), "word_counts")
    found = counts.join(closed(synonyms).withColumnRenamed("key", "_word_key"), "_word_key").select(
        "_word_key", F.col("value").alias("_word_value"))
    joined = _back(keyed, materialize(found, "words_found"), counts, "_word_key", split_rows)
    return joined.withColumn(out, F.coalesce("_word_value", F.col(f"`{column}`"))).drop("_word_key", "_word_value")


def expand_short_forms(df: DataFrame, column: str, entries: DataFrame, out: str, split_rows: int = HOT_SPLIT_ROWS) -> DataFrame:
    """``df`` with ``out``: ``column`` with short forms replaced by their expansions.

    Words are what single spaces and slashes divide. From the left, the entry with the most words that matches at
    a word replaces them, and the search goes on behind them; matches cross no slash, and what an expansion holds is
    not expanded again (chains of whole entries have been followed). An expansion with a slash is an error."""
    table = closed(entries)
    if not table.where(F.contains("value", F.lit("/"))).isEmpty():
        raise ValueError("an expansion must not hold a slash")
    # One number: the words of the longest key.
    longest = table.agg(F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(1))).first()[0]
    keyed = df.withColumn("_text_key", F.unhex(F.sha2(F.col(f"`{column}`").cast("binary"), 256)))
    counts = materialize(keyed.where("_text_key IS NOT NULL").groupBy("_text_key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col(f"`{column}`")).alias("_text")), "text_counts")
    texts = counts.select("_text_key", F.split(F.regexp_replace("_text", "/", " / "), " ").alias("_words"))
    grams = texts.select("_text_key", "_words", F.explode(F.sequence(F.lit(1), F.size("_words"))).alias("_at")).select(
        "_text_key", "_words", "_at",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_words") - F.col("_at") + 1))).alias("_size"))
    grams = grams.select("_text_key", "_at", "_size", F.lower(F.array_join(F.slice("_words", F.col("_at"), F.col("_size")), " ")).alias("key"))
    best = grams.join(table, "key").groupBy("_text_key", "_at").agg(F.max(F.struct("_size", "value")).alias("_hit"))
    hits = best.groupBy("_text_key").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_hit"))).alias("_hits"))

    def step(done, at):
        hit = F.try_element_at(F.col("_hits"), at)
        take = hit.isNotNull()
        return F.when(at < done["next"], done).otherwise(F.struct(
            F.when(take, at + hit["_size"]).otherwise(at + 1).alias("next"),
            F.array_append(done["words"], F.when(take, hit["value"]).otherwise(F.get(F.col("_words"), at - 1))).alias("words")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("words"))
    folded = F.aggregate(F.sequence(F.lit(1), F.size("_words")), start, step)["words"]
    found = texts.join(hits, "_text_key").select("_text_key", F.regexp_replace(F.array_join(folded, " "), " / ", "/").alias("_expanded"))
    joined = _back(keyed, materialize(found, "texts_expanded"), counts.select("_text_key", "n"), "_text_key", split_rows)
    return joined.withColumn(out, F.coalesce("_expanded", F.col(f"`{column}`"))).drop("_text_key", "_expanded")
