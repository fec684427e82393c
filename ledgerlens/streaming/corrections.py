"""Re-sent and corrected rows in a stream of statements.

Statements are sent again with rows that were there before, some of them corrected. :func:`changes_stream` keeps one small
state per row key (file and serial number): the digest, order and version of what was last passed on. A row that says the same
is dropped, a row that says something else comes out as the next version, a row older than what was passed on is dropped.
:func:`current_rows` reads the stored changes and keeps each key's last version.

The state is Spark's keyed state (``transformWithState``) in RocksDB, so it is spread over the tasks by key, restored from
the checkpoint after a lost executor or a restart, and forgotten after ``keep`` without a new version: a row re-sent later
than that counts as new and comes out as version 1 again, which :func:`current_rows` orders after the older ones.

Awkward input: rows without a serial number have no identity, so they are passed on as they are, every time (``change`` is
``unkeyed``), and need no state; a missing file is a key like others; equal orders within a key go by the digest; several
versions in one batch come out one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from ledgerlens.schema import quote
from ledgerlens.session import ship_package

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000


def _order(sent: str) -> Column:
    """Microseconds of a timestamp column; rows without it come first."""
    return F.coalesce(F.unix_micros(F.col(quote(sent)).cast("timestamp")), F.lit(0))


class _Versions(StatefulProcessor):
    """Numbers the versions of one key; its rows come as (order, digest, payload)."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "digest binary, sent bigint, version bigint", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        known = self.last.get() if self.last.exists() else None
        digest, sent, version = (bytes(known[0]), known[1], known[2]) if known else (None, None, 0)
        moved = False
        for row in sorted(rows, key=lambda r: (r["_sent"], bytes(r["_digest"]))):
            if bytes(row["_digest"]) == digest or (sent is not None and row["_sent"] < sent):
                continue
            digest, sent, version, moved = bytes(row["_digest"]), row["_sent"], version + 1, True
            yield Row(_file=key[0], _no=key[1], _sent=sent, _row=row["_row"], version=version,
                      change="new" if version == 1 else "corrected")
        if moved:
            self.last.update((digest, sent, version))

    def close(self) -> None:
        pass


def changes_stream(rows: DataFrame, sent: str, file: str = "source_file", number: str = "s_no",
                   keep_days: int = 400) -> DataFrame:
    """The columns of a stream of statement rows, ``version`` (null for rows without a number) and ``change`` (``new``,
    ``corrected`` or ``unkeyed``).

    ``sent`` is a timestamp column: when the row was sent (a file's time of change); it says which version is later and is
    itself not part of what a row says. Rows without it count as sent at the start of time."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_PROVIDER:
        raise RuntimeError("keyed state needs the RocksDB state store: call use_rocksdb_state(spark) first")
    ship_package(spark)  # executors run the processor
    said = F.struct(*[F.col(quote(c)) for c in rows.columns if c not in (sent, file, number)])
    keyed = rows.select(F.col(quote(file)).cast("string").alias("_file"), F.col(quote(number)).cast("string").alias("_no"),
                        _order(sent).alias("_sent"),
                        F.unhex(F.sha2(F.to_json(said, {"ignoreNullFields": "false"}), 256)).alias("_digest"),
                        F.struct(*[F.col(quote(c)) for c in rows.columns]).alias("_row"))
    numbered = StructType([StructField(f.name, f.dataType) for f in keyed.schema if f.name != "_digest"])
    numbered = numbered.add("version", "long").add("change", "string")
    out = keyed.where("_no IS NOT NULL").groupBy("_file", "_no").transformWithState(
        _Versions(keep_days * DAY_MS), numbered, "Append", "ProcessingTime")
    alone = keyed.where("_no IS NULL").select("_file", "_no", "_sent", "_row", F.lit(None).cast("bigint").alias("version"),
                                              F.lit("unkeyed").alias("change"))
    return out.unionByName(alone).select("_row.*", "version", "change")


def use_rocksdb_state(spark: SparkSession) -> None:
    """Set the state store that :func:`changes_stream` needs, and no batches without data: a state with a time to live would
    ask for one after the other, so that a run over what is there now never ends. Expired state goes with the next rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def current_rows(changes: DataFrame, sent: str, file: str = "source_file", number: str = "s_no") -> DataFrame:
    """What a stored :func:`changes_stream` says now: the last version of every key, and all rows without a number."""
    names = [c for c in changes.columns if c not in ("version", "change")]
    whole = F.struct(*[F.col(quote(c)) for c in names])
    order = F.struct(_order(sent), F.col("version"))
    last = changes.where(F.col(quote(number)).isNotNull()).groupBy(F.col(quote(file)).alias("_file"), F.col(quote(number)).alias("_no")).agg(
        F.max_by(whole, order).alias("_row")).select("_row.*")
    return last.unionByName(changes.where(F.col(quote(number)).isNull()).select(*[F.col(quote(c)) for c in names]))
