"""Spelling variants of the words of a corpus, by one-edit neighbourhoods over a reduced alphabet.

Every letter is hashed to one of a few symbols. Words one edit apart have
reduced words at most one edit apart, so the one-edit neighbourhood of each
reduced word (itself, deletions, replacements; insertions are the deletions of
the longer word) is generated and joined with the reduced vocabulary, and what
meets is compared letter by letter. The relation is symmetric: of two reduced
words the larger one (by length, then symbols) generates the smaller. The
number of symbols is the seventh root of the vocabulary's size, so that a reduced
seven-letter word stands for about one word whatever the corpus.

A reduced word that stands for more than ``CROWD`` words is not joined. The words
whose neighbourhoods meet it go through the same steps with more symbols, in
the end with every letter a symbol of its own, where each reduced word stands for
one word only. So no crowd is compared all with all and no pair is lost.

Counting is a plain aggregation of the exploded words, combined before the
shuffle. Forms are followed to their last by pointer jumping over the stored
table of (word, form); since counts at least double along it, it has no cycles.

Behaviour on awkward input: null and empty texts have no words; a null id is
written as nothing before the colon; repeated rows count each; long texts are read
whole; ties of forms go to the smallest word; an empty table gives an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import ascii_lower, stored, text_or_empty

#: Letters that make words, A-Z counting as a-z.
LETTERS = "".join(chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
RUNS = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run loses a letter where its hash is divisible by this.
SLIP = 97
#: Words that one reduced word may stand for.
CROWD = 64
#: Fewest symbols, and symbols where the first ones leave crowds.
FEWEST_SYMBOLS, MORE_SYMBOLS = 4, (32, len(LETTERS))
#: Root of the vocabulary's size taken as the number of symbols.
ROOT = 7


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``: every run of letters, less the letter that the run loses where ``SLIP`` divides its hash."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(ascii_lower(text_or_empty(docs[f"`{text_col}`"])), F.lit(RUNS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("hash"))
    at = F.pmod("hash", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.pmod("hash", F.lit(SLIP)) == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    words = occurrences(docs, id_col, text_col).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def symbols_for(words: int) -> int:
    """Symbols that a vocabulary of so many words is reduced to at first."""
    symbols = FEWEST_SYMBOLS
    while symbols ** ROOT < words:
        symbols += 1
    return min(symbols, len(LETTERS))


def _symbol(i: int) -> str:
    return chr(ord("0") + i)


def reduced(word: Column, symbols: int) -> Column:
    """Each letter's symbol; with as many symbols as letters each letter has its own."""
    places = [i if symbols >= len(LETTERS) else (zlib.crc32(f"letter {c}".encode()) >> 8) % symbols for i, c in enumerate(LETTERS)]
    return F.translate(word, LETTERS, "".join(map(_symbol, places)))


def neighbourhoods(words: DataFrame, symbols: int) -> DataFrame:
    """``word, key``: for each word the hash of its reduced word and of every string one edit from it that is
    smaller by length, then by symbols, each once."""
    size, char = F.length("reduced"), F.substring("reduced", F.col("at"), F.lit(1))
    before = F.substring("reduced", F.lit(1), F.col("at") - 1)
    after = F.substring("reduced", F.col("at") + 1, size)
    # Edit 0 deletes the letter, any other puts that symbol in its place; past the end stands the reduced word itself.
    edits = (words.select("word", reduced(F.col("word"), symbols).alias("reduced"))
             .withColumn("at", F.explode(F.sequence(F.lit(1), size + 1)))
             .withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in ["", *map(_symbol, range(symbols))]]))))
    inside = F.col("at") <= size
    first_of_run = (F.col("at") == 1) | (char != F.substring("reduced", F.col("at") - 1, F.lit(1)))
    kept = edits.where(F.when(F.col("symbol") == "", ~inside | first_of_run).otherwise(inside & (F.col("symbol") < char)))
    key = F.when(inside, F.concat(before, "symbol", after)).otherwise(F.col("reduced"))
    return kept.select("word", F.xxhash64(key).alias("key"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: all pairs of distinct words of the table ``words`` (word) that differ by one letter inserted, deleted
    or replaced, each pair in both directions."""
    pairs, symbols = None, symbols_for(words.count())
    for more in (*MORE_SYMBOLS, None):
        keyed = words.select(F.col("word").alias("near"), F.xxhash64(reduced(F.col("word"), symbols)).alias("key"))
        crowds = stored(keyed.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowds")
        last = symbols >= len(LETTERS) or crowds.isEmpty()
        targets = keyed if last else keyed.join(crowds, "key", "left_anti")
        # Merged, since the planner takes the neighbourhoods for as small as the words and might broadcast them.
        meeting = neighbourhoods(words, symbols).hint("merge").join(targets, "key").where("word != near")
        found = meeting.where(F.levenshtein("word", "near", 1) == 1).select(
            F.least("word", "near").alias("word"), F.greatest("word", "near").alias("near"))
        pairs = found if pairs is None else pairs.unionAll(found)
        if last:
            break
        words = stored(neighbourhoods(words, symbols).join(crowds, "key", "left_semi").select("word").distinct(), "crowded")
        symbols = max(symbols, more)
    both = stored(pairs.distinct(), "near-words")
    return both.unionAll(both.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word of ``forms`` (word, form; no cycles): the last word that its forms lead to."""
    known = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = stored(known.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = stored(vocabulary(docs, id_col, text_col), "vocabulary")
    near = near_words(words.select("word")).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    takes = -F.col("best.rank") >= 2 * F.col("n")
    judged = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"),
        F.when(takes, -F.col("best.rank")).alias("form_n")), "forms")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("bigint").alias("n_near"), "form_n")
