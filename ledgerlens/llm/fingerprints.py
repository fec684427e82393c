"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash that lies below a fixed fraction of the hash
range. Membership of a hash depends on the hash alone, so the sketch of a union
is the union of the sketches, and the share of one sketch found in another
estimates containment however unequal the two texts are. A sketch that would be
empty keeps its text's smallest hash, so that only a text without words has
none (merging drops it again where the other sketch has hashes below the
threshold).

Shingles are runs of five words, lower-cased A-Z, cut at ASCII white space; a
shorter text is one shingle. A hash is the first 16 hex digits of MD5, and the
threshold is compared as text. All of it is built-in SQL functions.

Behaviour on awkward input: null and empty texts, and white space only, have
the empty fingerprint, alike (1.0) to another empty one and unlike (0.0)
to all else; repeated rows are fingerprinted each; long texts are read whole;
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import ASCII_SPACE, ascii_lower, text_or_empty

SHINGLE_WORDS = 5
#: Hashes kept: those below this, of 16 hex digits; an eighth of all.
THRESHOLD = "2000000000000000"
#: Sampled ids for each range of neighbours; ranges for each shuffle partition, and at most.
SAMPLED, RANGES, MOST_RANGES = 32, 4, 16_384


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = SHINGLE_WORDS, threshold: str = THRESHOLD) -> DataFrame:
    """``df`` with the fingerprint of a text column: its sorted hashes, comma between. One column a step, so that
    nothing costly is evaluated twice."""
    words, hashes, low = f"__{out}_words", f"__{out}_hashes", f"__{out}_low"
    bare = F.btrim(ascii_lower(text_or_empty(text_col)), F.lit(" \t\n\x0b\x0c\r"))
    shingle = lambda i: F.array_join(F.slice(F.col(words), i, F.lit(k)), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(F.col(words)) - (k - 1), F.lit(1)))
    return (df.withColumn(words, F.split(bare, f"[{ASCII_SPACE}]+"))
            .withColumn(hashes, F.transform(starts, lambda i: F.left(F.md5(shingle(i).cast("binary")), F.lit(16))))
            .withColumn(low, F.filter(hashes, lambda h: h < threshold))
            .withColumn(out, F.when(F.col(words)[0] == "", "")  # only a text without words has an empty first word
                        .when(F.size(low) > 0, F.array_join(F.array_sort(F.array_distinct(low)), ","))
                        .otherwise(F.array_min(hashes)))
            .drop(words, hashes, low))


def _set(fingerprint: Column) -> Column:
    return F.when(fingerprint == "", F.array().cast("array<string>")).otherwise(F.split(fingerprint, ","))


def _packed(fingerprint: Column) -> Column:
    """Eight bytes a hash, for the shuffle."""
    return F.unhex(F.replace(fingerprint, F.lit(","), F.lit("")))


def _unpacked(packed: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(packed)), "(.{16})(?=.)", "$1,")


def merge(a: Column, b: Column, threshold: str = THRESHOLD) -> Column:
    """Fingerprint of the union of two shingle sets."""
    both = F.array_union(_set(a), _set(b))
    low = F.filter(both, lambda h: h < threshold)
    return F.when(F.size(low) > 0, F.array_join(F.array_sort(low), ",")).otherwise(F.coalesce(F.array_min(both), F.lit("")))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one holds: 0 to 1; two empty ones are alike."""
    least = F.least(F.size(_set(a)), F.size(_set(b)))
    return F.when(a == b, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(_set(a), _set(b))) / least)


def resemblance(a: Column, b: Column) -> Column:
    """Jaccard estimate: 0 to 1; two empty ones are alike."""
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(_set(a), _set(b))) / F.size(F.array_union(_set(a), _set(b))))


def range_bounds(ids: DataFrame, ranges: int, seed: int = 11) -> list[int]:
    """Ids that cut the sorted ids into about ``ranges`` ranges of like size, ascending; the last is the largest id.
    At most ``SAMPLED`` ids a range reach the driver, whatever the table's size."""
    stats = ids.agg(F.count("id"), F.max("id")).first()
    if not stats[0]:
        return []
    sampled = sorted(r[0] for r in ids.where("id IS NOT NULL").sample(min(1.0, SAMPLED * ranges / stats[0]), seed)
                     .limit(2 * SAMPLED * ranges).collect())
    step = max(1, len(sampled) // ranges)
    return sorted({*sampled[step - 1::step], stats[1]})


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` below ``key``, by binary search inside the expression."""
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = F.get(held, middle) < key
        return F.struct(F.when(span["low"] >= span["high"], span["low"]).when(below, middle + 1).otherwise(span["low"]).alias("low"),
                        F.when(span["low"] >= span["high"], span["high"]).when(below, span["high"]).otherwise(middle).alias("high"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve)["low"]


def with_next(rows: DataFrame, carried: list[str], bounds: list[int]) -> DataFrame:
    """``rows`` (id, text, ...) with ``next``, a struct of the ``carried`` columns of the row that follows in
    descending id (ties by text, null ids last; after the last row the first).

    Rows are dealt out by range of id, and the row at the upper end of a range goes to the next range too, where it
    follows the smallest id: neighbours meet with one shuffle and no task sees the whole order."""
    if bounds:
        own = F.least(F.coalesce(range_of(F.col("id"), bounds), F.lit(0)), F.lit(len(bounds) - 1))
        held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        rows = rows.withColumn("__own", own)
        edge = F.col("id") == F.get(held, F.col("__own"))
        after = F.pmod(F.col("__own") + 1, F.lit(len(bounds)))
        places = F.when(edge, F.array(F.struct(F.lit(False).alias("halo"), F.col("__own").alias("range")),
                                      F.struct(F.lit(True).alias("halo"), after.alias("range")))
                        ).otherwise(F.array(F.struct(F.lit(False).alias("halo"), F.col("__own").alias("range"))))
        rows = rows.withColumn("__place", F.explode(places)).drop("__own")
    else:  # no ids at all
        rows = rows.withColumn("__place", F.struct(F.lit(False).alias("halo"), F.lit(0).alias("range")))
    order = Window.partitionBy(F.col("__place.range")).orderBy(F.col("__place.halo"), F.col("id").desc_nulls_last(), F.col("text"))
    what = F.struct(*carried)
    following = F.lead(what).over(order)
    if not bounds:
        following = F.coalesce(following, F.first(what).over(order))
    return rows.withColumn("next", following).where("NOT __place.halo").drop("__place")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text (the last half of its characters replaced by the first as many
    of the next document's), with the likeness to the edited text and to the next document: ``near_*`` by
    containment, ``jaccard_*`` by resemblance."""
    spark = docs.sparkSession
    if ranges is None:
        ranges = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), text_or_empty(docs[f"`{text_col}`"]).alias("text"))
    bounds = range_bounds(docs.select(docs[f"`{id_col}`"].alias("id")), ranges)
    rows = with_fingerprint(rows, "text", "fingerprint").withColumn("fingerprint", _packed(F.col("fingerprint")))
    rows = with_next(rows, ["text", "fingerprint"], bounds)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.col("next.text"), half))
    rows = rows.select("id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"),
                       _unpacked(F.col("fingerprint")).alias("fingerprint"),
                       _unpacked(F.col("next.fingerprint")).alias("next_fingerprint"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    own, other, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", containment(own, other).alias("near_edited"),
                       containment(own, following).alias("near_next"), resemblance(own, other).alias("jaccard_edited"),
                       resemblance(own, following).alias("jaccard_next"))
