"""Summaries kept up to date file by file.

A :class:`SummaryStore` holds, for every statement file, the mergeable state of its rows: per (category, subcategory) the
counts, sums and date bounds of :func:`ledgerlens.operators.summary.grouped`, a sketch of the distinct remarks (HLL) and one
of the withdrawals (KLL). ``refresh`` lists the files, reads only those that are new or changed since the last time, and
writes their state as one more generation; summaries merge the state of the files that are there now. Counts, sums and dates
are exact, whatever the order of refreshes; distinct remarks and quantiles are the sketches' estimates.

Layout under ``path``: ``state/generation=n`` (one row per file and group) and ``files/generation=n`` (all files of that
time, each with the generation that holds its state). The listing is written last, by Spark's commit protocol, and the newest
committed one counts: a refresh that is lost half-way leaves the store as it was, and the next one writes over its state.
One refresh at a time; readers may read meanwhile.

A file is unchanged if path, length and time of change are the same. Listing and comparing are Spark jobs over the metadata of
files; only the names of the files to read come to the driver, where Spark's readers take them.

Awkward input: an empty file has no state and is not read again; a folder without files gives empty summaries; a file that
went away takes its rows along; rows without category or subcategory make groups of their own, as in a full summary.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import is_blank
from ledgerlens.operators import summary
from ledgerlens.schema import MONEY, find_col, quote
from ledgerlens.sources.statement import read_statements

#: log2 of an HLL sketch's registers (about 1.6% error) and the KLL accuracy parameter (about 1.3% of rank).
REMARK_REGISTERS, AMOUNT_ACCURACY = 12, 200

_FILES_DDL = "source_file string, length bigint, modified timestamp, generation bigint"
_STATE_DDL = (f"source_file string, category string, subcategory string, transactions bigint, withdrawals decimal(28,2), "
              "deposits decimal(28,2), start date, end date, remarks binary, amounts binary")
_SUFFIX = {"csv": "*.[cC][sS][vV]", "parquet": "*.[pP][aA][rR][qQ][uU][eE][tT]", "xlsx": "*.[xX][lL][sS][xX]"}


def file_groups(df: DataFrame) -> DataFrame:
    """The state of each ``source_file`` of a statement: one row per (category, subcategory) in it."""
    d = summary.with_txn_date(df)
    text = lambda name: F.col(quote(find_col(d, name))) if find_col(d, name) else F.lit(None).cast("string")
    rows = d.select("source_file", text("category").alias("category"), text("subcategory").alias("subcategory"), "remarks",
                    F.col("withdrawal").cast(MONEY).alias("withdrawal"), F.col("deposit").cast(MONEY).alias("deposit"), "txn_date")
    known = F.when(~is_blank(F.col("remarks")), F.col("remarks"))
    return rows.groupBy("source_file", "category", "subcategory").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("withdrawal").alias("withdrawals"), F.sum("deposit").alias("deposits"),
        F.min("txn_date").alias("start"), F.max("txn_date").alias("end"),
        F.hll_sketch_agg(known, F.lit(REMARK_REGISTERS)).alias("remarks"),
        F.kll_sketch_agg_double(F.col("withdrawal").cast("double"), F.lit(AMOUNT_ACCURACY)).alias("amounts"))


def merged(state: DataFrame, *keys: str) -> DataFrame:
    """State rows merged per ``keys`` (all of them into one row without keys), sketches included."""
    return state.groupBy(*keys).agg(
        F.coalesce(F.sum("transactions"), F.lit(0)).cast("bigint").alias("transactions"), F.sum("withdrawals").alias("withdrawals"),
        F.sum("deposits").alias("deposits"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.hll_union_agg("remarks").alias("remarks"), F.kll_merge_agg_double("amounts").alias("amounts"))


def distinct_remarks(sketch) -> Column:
    """Estimated number of distinct remarks of a merged sketch."""
    return F.hll_sketch_estimate(sketch)


def withdrawal_quantile(sketch, share: float) -> Column:
    """Estimated ``share`` quantile of the withdrawals of a merged sketch (null where there are none)."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


class SummaryStore:
    """Mergeable summaries of the statement files below ``source``, kept under ``path`` on shared storage.

    ``enrich`` (statement to statement) is applied to the rows of every file read, for instance a backend's
    ``categorise``; it must treat files alone, as later files are not there yet. A store belongs to one ``enrich``."""

    def __init__(self, spark: SparkSession, path: str, source: str, fmt: str = "parquet",
                 enrich: Callable[[DataFrame], DataFrame] | None = None, read_options: dict | None = None):
        if fmt not in _SUFFIX:
            raise ValueError(f"unknown format: {fmt}")
        self.spark, self.path, self.source, self.fmt = spark, path.rstrip("/"), source, fmt
        self.enrich, self.read_options = enrich or (lambda df: df), read_options

    def _generation(self) -> int:
        """The newest committed listing, 0 where there is none."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/files/generation=*/_SUCCESS")
        found = done.getFileSystem(conf).globStatus(done)
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)

    def files(self) -> DataFrame:
        """``source_file, length, modified, generation`` of the last refresh."""
        return self._files(self._generation())

    def _files(self, generation: int) -> DataFrame:
        if not generation:
            return self.spark.createDataFrame([], _FILES_DDL)
        return self.spark.read.schema(_FILES_DDL).parquet(f"{self.path}/files/generation={generation}")

    def _listed(self) -> DataFrame:
        """Files there now; their contents are not read."""
        found = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", _SUFFIX[self.fmt]).load(self.source))
        return found.select(F.col("_metadata.file_path").alias("source_file"), "length", F.col("modificationTime").alias("modified"))

    def refresh(self) -> dict[str, int]:
        """Bring the store up to the files there now; how many files were ``read``, ``kept`` and ``removed``."""
        last = self._generation()
        old, new = self._files(last), last + 1
        state, files = (f"{self.path}/{part}/generation={new}" for part in ("state", "files"))
        # The new listing is stored first, so that reading and committing see the same files.
        listing = f"{self.path}/listing/generation={new}"
        self._listed().join(old, ["source_file", "length", "modified"], "left").write.mode("overwrite").parquet(listing)
        now = self.spark.read.schema(_FILES_DDL).parquet(listing)
        due = [r["source_file"] for r in now.where("generation IS NULL").select("source_file").toLocalIterator()]
        if due:
            rows = read_statements(self.spark, due, self.fmt, self.read_options)
            file_groups(self.enrich(rows)).write.mode("overwrite").parquet(state)
        removed = old.join(now, "source_file", "left_anti").count()
        kept = now.where("generation IS NOT NULL").count()
        if due or removed or not last:
            now.withColumn("generation", F.coalesce("generation", F.lit(new).cast("bigint"))).write.mode("overwrite").parquet(files)
        return {"read": len(due), "kept": kept, "removed": removed}

    def compact(self) -> None:
        """Write the live state as one generation, so that the state of changed and removed files is read no longer."""
        last = self._generation()
        if not last:
            return
        self.state().write.mode("overwrite").parquet(f"{self.path}/state/generation={last + 1}")
        self._files(last).withColumn("generation", F.lit(last + 1).cast("bigint")).write.mode("overwrite").parquet(
            f"{self.path}/files/generation={last + 1}")

    def state(self) -> DataFrame:
        """The state of the files of the last refresh, as :func:`file_groups` gives it."""
        live = self.files()
        # Generations that hold something: as many as refreshes since the last compaction.
        used = [r["generation"] for r in live.select("generation").distinct().collect()]
        folders = [f"{self.path}/state/generation={g}" for g in used if self._written(g)]
        if not folders:
            return self.spark.createDataFrame([], _STATE_DDL)
        stored = self.spark.read.schema(f"{_STATE_DDL}, generation bigint").option("basePath", f"{self.path}/state").parquet(*folders)
        return stored.join(live.select("source_file", "generation"), ["source_file", "generation"], "left_semi").drop("generation")

    def _written(self, generation: int) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/generation={generation}/_SUCCESS")
        return done.getFileSystem(conf).exists(done)

    def grouped(self) -> DataFrame:
        """What :func:`ledgerlens.operators.summary.grouped` gives over all rows, with the merged sketches."""
        return merged(self.state(), "category", "subcategory")

    def totals(self) -> DataFrame:
        """What :func:`ledgerlens.operators.summary.summary_totals` gives over all rows."""
        return summary.totals_of(self.grouped(), True, True)

    def report(self) -> DataFrame:
        """What :func:`ledgerlens.operators.summary.summary_report` gives over all rows."""
        return summary.report_of(self.grouped(), True, True)

    def context(self) -> DataFrame:
        """What :func:`ledgerlens.operators.summary.chat_context` gives over all rows."""
        return summary.context_of(self.grouped(), True)
