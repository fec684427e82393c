"""Small tables with every awkward kind of row."""

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"wort{i % 977} satz{i % 13}" for i in range(30_000))

#: id, text: nulls, empty and blank texts, one word, a long text, copies, near copies, repeated rows, no id, other scripts.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from the old farm house."),
    (2, None), (3, ""), (4, " \t\r\n "), (5, "word"), (6, LONG), (7, "one two"),
    (8, "The quick brown fox jumps over the lazy dog and runs far away from the old farm house."),
    (9, "The quick brown fox jumps over the lazy dog and runs far away from the old farm home."),
    (9, "The quick brown fox jumps over the lazy dog and runs far away from the old farm home."),
    (None, "The quick brown fox jumps over the lazy dog and runs far away from the old farm house."),
    (None, "no id here, only a text of a few words to be seen by everything"),
    (None, None), (10, "don't  stop'll\n\nx're 123 4½ ... çà et là ΑΣ İstanbul 中文字 \U0001F600́"),
    (11, LONG + " end"), (12, "<|endoftext|> '''s 's  !!"), (10_000_000_000, "word"),
]


def frame(spark, rows=ROWS):
    """The rows with further columns, named like those that operators make themselves."""
    names = ["id", "label", "score", "hash", "n", "kept", "next", "rep", "prefix", "dir", "words", "stats"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
                          + [T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in rows], schema)


@pytest.fixture()
def awkward(spark):
    return frame(spark)


@pytest.fixture()
def nothing(spark):
    return frame(spark, [])
