"""Reading the input tables and small column helpers shared by the operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import apply_semantic_conf, ensure_checkpoint_dir, fresh_shared_dir, ship_package

#: ASCII white space, as a character class body: space, tab to carriage return.
ASCII_SPACE = r"\x20\x09-\x0D"

#: Bytes of an Arrow batch sent to a Python worker, so that whole long texts do not pile up in it.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Shared folder known and the package importable on the executors."""
    apply_semantic_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared folder and read back: lineage ends
    there, so a lost executor re-reads the table instead of recomputing it."""
    path = fresh_shared_dir(df.sparkSession, f"ledgerlens/llm/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most ``rows`` rows in an Arrow batch of the jobs run inside: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_fold(col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``part`` modulo ``parts``
    (the held-out fold). A null id belongs to no fold."""
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(parts)) == F.lit(part),
                      F.lit(False))


def settled(known: DataFrame) -> DataFrame:
    """``id, label`` once for every id of ``known`` (id, label) whose rows agree on the label; ids with both teach nothing."""
    return known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")
