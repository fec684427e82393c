"""Streaming ingest of new statement files.

``start_statement_stream`` watches a folder of statement files (parquet,
CSV or workbooks, display or engine column names), and for every micro-batch runs the
same batch enrichment as the offline pipeline inside ``foreachBatch``:
validate -> clean remarks -> categorise -> write. Each epoch is written to
its own folder with overwrite, so a replayed epoch (after a driver or
executor failure) replaces its output instead of duplicating it; progress
lives in the checkpoint under the shared folder. Call de-duplication runs
per batch (and the reply store spans batches, so a prompt is still paid for
once).

``monthly_spend_stream`` is the streaming form of the monthly trend: a
watermark on the transaction month bounds the aggregation state, and a
month's totals are emitted once the watermark passes it (append mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.dates import with_statement_date
from ledgerlens.operators.enrich import enrich_statement
from ledgerlens.operators.rules import RuleBackend
from ledgerlens.schema import ENGINE_TYPES, REQUIRED_COLUMNS, STATEMENT_DDL, quote
from ledgerlens.session import apply_semantic_conf, scratch_scope, shared_dir
from ledgerlens.sources.statement import CSV_READ_OPTIONS, normalize_statement
from ledgerlens.sources.workbook import stream_workbooks


def _prepare(batch: DataFrame) -> DataFrame:
    if set(REQUIRED_COLUMNS) <= set(batch.columns):
        batch, _extras = normalize_statement(batch, carry=("source_file",))
    return batch.select(*[F.col(quote(c)).try_cast(t).alias(c) if t else F.col(quote(c))
                          for c, t in [(c, ENGINE_TYPES.get(c)) for c in batch.columns]])


def _source_schema(spark: SparkSession, source_dir: str, fmt: str, options: dict, display_names: bool) -> str:
    """The columns of the files there now, extras included (a stream needs
    them before it starts); the statement's own columns where there are none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(path)):
        found = spark.read.options(**options).format(fmt).load(source_dir).schema
        return ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in found)
    return ", ".join(f"{quote(c)} string" for c in REQUIRED_COLUMNS) if display_names else STATEMENT_DDL


def start_statement_stream(spark: SparkSession, source_dir: str, output_dir: str, *,
                           backend=None, category_backend=None, fmt: str = "parquet",
                           display_names: bool = False, schema: str | None = None, checkpoint: str | None = None,
                           max_files_per_trigger: int | None = None, available_now: bool = True,
                           query_name: str = "statement_ingest"):
    """Start the ingest query; returns the ``StreamingQuery``. Columns beyond
    the statement's own are kept: ``schema`` names all columns, by default those
    of the files there at the start.

    ``available_now=True`` processes what is there and stops (batch-like
    runs, tests); ``False`` keeps polling every 30 seconds.
    """
    apply_semantic_conf(spark)
    backend = backend or RuleBackend()
    options = CSV_READ_OPTIONS if fmt == "csv" else {}
    if fmt == "xlsx":
        names = StructType.fromDDL(schema).names if schema else None
        stream = stream_workbooks(spark, source_dir, names, max_files_per_trigger)
        stream = stream.withColumnRenamed("_source_file", "source_file").drop("_row_id")
    else:
        schema = schema or _source_schema(spark, source_dir, fmt, options, display_names)
        reader = spark.readStream.schema(schema).format(fmt).options(**options)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        stream = reader.load(source_dir).withColumn("source_file", F.col("_metadata.file_path"))
    checkpoint = checkpoint or shared_dir(spark, "ledgerlens", "streams", query_name)

    def handle(batch: DataFrame, epoch_id: int) -> None:
        # Intermediate tables of the batch are removed once its output is written.
        with scratch_scope(batch.sparkSession):
            st = _prepare(batch)
            out = enrich_statement(st, backend, category_backend)
            out.write.mode("overwrite").parquet(f"{output_dir.rstrip('/')}/epoch={epoch_id}")

    w = (stream.writeStream.queryName(query_name).option("checkpointLocation", checkpoint)
         .foreachBatch(handle))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# Dates outside these are typing errors; one far in the future would move the watermark past everything.
PLAUSIBLE_FROM, PLAUSIBLE_AHEAD_DAYS = "1970-01-01", 366


def implausible(txn_date) -> Column:
    """Whether a transaction date is missing or cannot be right."""
    return txn_date.isNull() | (txn_date < F.lit(PLAUSIBLE_FROM).cast("date")) | (
        txn_date > F.date_add(F.current_date(), PLAUSIBLE_AHEAD_DAYS))


def monthly_spend_stream(enriched: DataFrame, lateness: str = "62 days") -> DataFrame:
    """Streaming withdrawals per (month, category) of an enriched statement
    stream, emitted in append mode once the watermark passes the month. Rows
    with an implausible date are left out (:func:`rejected_dates` counts them); rows
    later than ``lateness`` show as ``numRowsDroppedByWatermark`` in the progress."""
    d = with_statement_date(enriched) if "txn_date" not in enriched.columns else enriched
    d = d.where(~implausible(F.col("txn_date")) & F.col("category").isNotNull())
    d = d.withColumn("month_start", F.date_trunc("month", F.col("txn_date").cast("timestamp")))
    return (d.withWatermark("month_start", lateness)
            .groupBy("month_start", "category")
            .agg(F.sum("withdrawal").alias("spent"), F.count(F.lit(1)).alias("transactions")))


def rejected_dates(enriched: DataFrame) -> DataFrame:
    """One row: rows that :func:`monthly_spend_stream` leaves out for their date."""
    d = with_statement_date(enriched) if "txn_date" not in enriched.columns else enriched
    return d.agg(F.count_if(implausible(F.col("txn_date"))).alias("rejected"), F.count(F.lit(1)).alias("rows"))
