"""Batch enrichment: prompts -> backend replies -> parsed result columns.

Plan shape (per stage)::

    statement --project prompt--> distinct prompts --left_anti answered prompts-->
    repartition(k) --mapInPandas(backend)--> append to reply store (committed in chunks)
    statement --left join on sha256(prompt)--> stored replies --> native parse

Prompts holding more than ``split_rows`` rows are spread over several tasks
in the join back, and rows without a prompt over all tasks
(:mod:`ledgerlens.operators.joins`).

The join back carries a 32-byte digest of the prompt instead of its text, so
the statement-sized shuffle is not widened by the prompt template. The store
keeps that digest as a column and is partitioned by its first hex digit.

Each answered call is paid once: the replies are written before anything reads
them, so later actions (and retried downstream stages) read the stored
table instead of re-running the calls. A call that failed is stored with its
error and made again by the next run; a later success replaces it. Blank inputs
never reach the backend. The global concurrency cap is ``k`` tasks x
``max_concurrency // k`` threads, under every option.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.replies import LOW, UNCLEAR, with_parsed_category, with_parsed_remark
from ledgerlens.operators.backends import Backend, NativeBackend
from ledgerlens.operators.joins import HOT_SPLIT_ROWS, hot_keys, split_hot_join
from ledgerlens.operators.prompts import (CATEGORY_SYSTEM_PROMPT, REMARK_SYSTEM_PROMPT,
                                          category_prompt, filled, remark_prompt, with_remark_template)
from ledgerlens.schema import AMOUNT_UNPARSEABLE, description_column
from ledgerlens.session import apply_semantic_conf, fresh_shared_dir, intermediate, materialize, shared_dir, ship_package

REPLY_SCHEMA = ("prompt_key binary, prompt string, response string, error string, run_id string, "
                "written_at bigint, key_prefix string")
DEFAULT_MAX_CONCURRENCY = 10
# Prompts called between two commits of the reply store: what a lost run pays for again, at most.
CHUNK_PROMPTS = 100_000
# Commits of one run at most, so what commits cost does not grow with a run of millions of calls: a lost run pays again for
# the larger of a chunk and this part of its calls.
MOST_COMMITS = 20
# Files that a chunk of calls is dealt into, at most.
CHUNK_FILES = 8
# Partitions of the reply store: first hex digits of the digest.
PREFIXES = 16


def prompt_key(c) -> Column:
    """32-byte SHA-256 digest of a prompt (NULL for a NULL prompt): the join
    key between statement rows and stored replies."""
    return F.unhex(F.sha2((F.col(c) if isinstance(c, str) else c).cast("binary"), 256))


def _prefix(key: Column) -> Column:
    return F.substring(F.lower(F.hex(key)), 1, 1)


class ReplyStore:
    """Append-only parquet table of replies per backend, stage and system
    prompt, kept under the cluster's shared folder by default. One row per call:
    ``prompt_key`` names the call (the prompt's digest; with one call per row, the
    digest of prompt and row key)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    @classmethod
    def default(cls, spark: SparkSession, backend: Backend, stage: str, system_prompt: str | None = None) -> "ReplyStore":
        asked = hashlib.sha256((system_prompt or "").encode()).hexdigest()[:12]
        return cls(spark, shared_dir(spark, "ledgerlens", "replies", backend.fingerprint(), f"{stage}-{asked}"))

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(p)

    def raw(self, keys: DataFrame | None = None) -> DataFrame | None:
        """Stored rows; with ``keys`` (a ``prompt_key`` column) only the
        partitions that can hold them are read."""
        if not self._exists():
            return None
        rows = self.spark.read.schema(REPLY_SCHEMA).parquet(self.path)
        if keys is not None:
            # At most PREFIXES values, whatever the batch.
            held = [r[0] for r in keys.select(_prefix(F.col("prompt_key")).alias("p")).distinct().collect()]
            rows = rows.where(F.col("key_prefix").isin(held))
        return rows

    def answered(self, keys: DataFrame | None = None) -> DataFrame | None:
        """``prompt_key`` of the calls that have a response."""
        rows = self.raw(keys)
        return None if rows is None else rows.where(F.col("response").isNotNull()).select("prompt_key")

    def replies_by_key(self, keys: DataFrame | None = None) -> DataFrame:
        """``(prompt_key, response, error)``, one row per call: the earliest
        response, or the earliest error where there is no response yet.

        ``keys`` (one ``prompt_key`` column) restricts the store to the
        prompts at hand before the per-prompt reduction, so a small batch
        (a streaming micro-batch) does not reduce every reply ever stored."""
        rows = self.raw(keys)
        if rows is None:
            return self.spark.createDataFrame([], "prompt_key binary, response string, error string")
        rows = rows.select("prompt_key", "response", "error", "run_id", "written_at")
        if keys is not None:
            rows = rows.join(keys.select("prompt_key"), "prompt_key", "left_semi")
        best = F.min(F.struct(F.col("response").isNull(), "written_at", "run_id", "response", "error")).alias("b")
        return (rows.groupBy("prompt_key").agg(best)
                .select("prompt_key", F.col("b.response").alias("response"),
                        F.col("b.error").alias("error")))

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").partitionBy("key_prefix").parquet(self.path)


def _caller(backend: Backend, system_prompt: str | None, pool_size: int, run_id: str):
    def run(batches):
        backend.open()
        try:
            for pdf in batches:
                out = backend.call_batch(pdf["prompt"].tolist(), system_prompt, pool_size=pool_size)
                yield pd.DataFrame({
                    "prompt_key": pdf["prompt_key"],
                    "prompt": pdf["prompt"],
                    "response": [r for r, _ in out],
                    "error": [e for _, e in out],
                    "run_id": run_id,
                    "written_at": int(time.time() * 1000),
                    "key_prefix": [bytes(k).hex()[:1] for k in pdf["prompt_key"]],
                })
        finally:
            backend.close()
    return run


def call_missing(prompts: DataFrame, backend: Backend, system_prompt: str | None,
                 store: ReplyStore, max_concurrency: int = DEFAULT_MAX_CONCURRENCY,
                 partitions: int | None = None, chunk_prompts: int = CHUNK_PROMPTS, most_commits: int = MOST_COMMITS) -> None:
    """Call the backend once per row of ``prompts`` (distinct ``prompt_key``,
    ``prompt``) that ``store`` has no response for, and append the replies.

    The calls are committed to the store in chunks of about ``chunk_prompts``, or of
    a ``most_commits``-th of the run where that is more,
    so a run that is lost repeats the calls of one chunk at most."""
    spark = prompts.sparkSession
    ship_package(spark)
    answered = store.answered(prompts)
    todo = prompts.select("prompt_key", "prompt")
    if answered is not None:
        todo = materialize(todo.join(answered, "prompt_key", "left_anti"), "prompts_to_call")
    k = max(1, min(partitions or max_concurrency, max_concurrency))
    pool = max(1, max_concurrency // k)
    run_id = uuid.uuid4().hex
    for part in _in_chunks(todo, chunk_prompts, most_commits):
        replies = part.repartition(k).mapInPandas(_caller(backend, system_prompt, pool, run_id), REPLY_SCHEMA)
        store.append(replies.repartition(PREFIXES, "key_prefix"))  # a file for each prefix


def _in_chunks(todo: DataFrame, chunk_prompts: int, most: int) -> Iterator[DataFrame]:
    """The calls in chunks of about ``chunk_prompts``, ``most`` chunks at most, by their digest. They are written once more with a folder for each
    chunk, and a chunk is read from its own folder: each call is read once, however many chunks there are."""
    spark = todo.sparkSession
    chunks = min(-(-todo.count() // chunk_prompts), most)
    if chunks < 2:
        yield from [todo] * chunks
        return
    path = fresh_shared_dir(spark, "ledgerlens/tables/prompts_by_chunk")
    dealt = todo.withColumn("chunk", F.pmod(F.xxhash64("prompt_key"), F.lit(chunks)).cast("int"))
    piece = F.pmod(F.xxhash64("prompt_key", F.lit(1)), F.lit(CHUNK_FILES))
    dealt.repartition("chunk", piece).write.partitionBy("chunk").parquet(path)
    intermediate(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    for name in sorted(f.getPath().getName() for f in found if f.isDirectory()):
        yield spark.read.schema(todo.schema).parquet(f"{path}/{name}")


def _attach(df: DataFrame, prompt_col: str, backend: Backend, system_prompt: str, stage: str,
            store: ReplyStore | None, dedupe: bool, row_key: list[str] | None, max_concurrency: int,
            partitions: int | None, chunk_prompts: int, split_rows: int) -> DataFrame:
    spark = df.sparkSession
    store = store or ReplyStore.default(spark, backend, stage, system_prompt)
    if dedupe:
        key = prompt_key(prompt_col)
    else:
        # One call per row: the row's key makes its call its own.
        row_key = row_key or [c for c in ("source_file", "row_id") if c in df.columns]
        if not row_key:
            raise ValueError("one call per row needs row_key: columns that name a row")
        named = F.to_json(F.struct(*[F.col(f"`{c}`") for c in row_key]), {"ignoreNullFields": "false"})
        key = prompt_key(F.concat(F.col(prompt_col), F.lit("\n"), named))
    keyed = df.withColumn("_pkey", key)
    # One aggregate gives the distinct calls and the rows per call (for
    # splitting hot prompts in the join back); it is written once and read by both.
    counts = materialize(keyed.where(F.col("_pkey").isNotNull())
                         .groupBy(F.col("_pkey").alias("prompt_key"), F.col(prompt_col).alias("prompt"))
                         .agg(F.count(F.lit(1)).alias("n")), f"prompt_counts_{stage}")
    call_missing(counts, backend, system_prompt, store, max_concurrency, partitions, chunk_prompts)
    replies = store.replies_by_key(counts).withColumnRenamed("prompt_key", "_pkey")
    hot = hot_keys(counts.select(F.col("prompt_key").alias("_pkey"), "n"), "_pkey", split_rows=split_rows)
    # Rows without a prompt have a NULL key: they keep NULL replies.
    return split_hot_join(keyed.drop(prompt_col), replies, "_pkey", hot)


def clean_remarks(df: DataFrame, backend, store: ReplyStore | None = None, dedupe: bool = True,
                  max_concurrency: int = DEFAULT_MAX_CONCURRENCY,
                  partitions: int | None = None, chunk_prompts: int = CHUNK_PROMPTS,
                  split_rows: int = HOT_SPLIT_ROWS, row_key: list[str] | None = None,
                  templated: bool = False) -> DataFrame:
    """Add ``cleaned_remark`` and ``notes_doubts``. Blank remarks give
    ('', '') without a call; row count and all input columns are kept.

    ``templated``: one call per remark template instead of one per remark. The ids in a remark (numbers, handles,
    bank codes) are sent as numbered slots, and where the reply names a slot the row's own text is put back
    (:func:`ledgerlens.operators.prompts.with_remark_template`). A backend that copies slots as it copies other words gives the
    results of one call per remark; one that drops them leaves ids out of the reading."""
    if "remarks" not in df.columns:
        raise ValueError("statement must contain a remarks column")
    if isinstance(backend, NativeBackend):
        return backend.clean_remarks(df)
    apply_semantic_conf(df.sparkSession)
    cols = [c for c in df.columns if c not in ("cleaned_remark", "notes_doubts")]
    if templated:
        with_prompt = with_remark_template(df)
        with_prompt = with_prompt.withColumn("_prompt", remark_prompt("_template")).drop("_template")
    else:
        with_prompt = df.withColumn("_prompt", remark_prompt("remarks"))
    joined = _attach(with_prompt, "_prompt", backend, REMARK_SYSTEM_PROMPT, "remark", store,
                     dedupe, row_key, max_concurrency, partitions, chunk_prompts, split_rows)
    if templated:
        joined = joined.withColumn("response", filled(F.col("response"), F.col("_slots")))
    parsed = with_parsed_remark(joined.drop(*[c for c in ("cleaned_remark", "notes_doubts")
                                              if c in joined.columns]), "response", "error")
    blank = F.col("_pkey").isNull()
    return parsed.select(*cols,
                         F.when(blank, F.lit("")).otherwise(F.col("cleaned_remark")).alias("cleaned_remark"),
                         F.when(blank, F.lit("")).otherwise(F.col("notes_doubts")).alias("notes_doubts"))


def categorise(df: DataFrame, backend, store: ReplyStore | None = None, dedupe: bool = True,
               max_concurrency: int = DEFAULT_MAX_CONCURRENCY,
               partitions: int | None = None, chunk_prompts: int = CHUNK_PROMPTS,
               split_rows: int = HOT_SPLIT_ROWS, row_key: list[str] | None = None) -> DataFrame:
    """Add ``category``, ``subcategory``, ``confidence``. Reads the cleaned
    remark when that column exists, else the raw remark; blank text, or an
    amount that is not a number, gives ('Unclear', '', 'Low') without a call."""
    desc = description_column(df.columns)
    if isinstance(backend, NativeBackend):
        return backend.categorise(df)
    apply_semantic_conf(df.sparkSession)
    cols = [c for c in df.columns if c not in ("category", "subcategory", "confidence")]
    w = "withdrawal" if "withdrawal" in df.columns else F.lit(None)
    d = "deposit" if "deposit" in df.columns else F.lit(None)
    prompt = category_prompt(desc, w, d)
    if AMOUNT_UNPARSEABLE in df.columns:
        prompt = F.when(~F.coalesce(AMOUNT_UNPARSEABLE, F.lit(False)), prompt)  # Unclear without a call
    with_prompt = df.withColumn("_prompt", prompt)
    joined = _attach(with_prompt, "_prompt", backend, CATEGORY_SYSTEM_PROMPT, "category", store,
                     dedupe, row_key, max_concurrency, partitions, chunk_prompts, split_rows)
    parsed = with_parsed_category(joined.drop(*[c for c in ("category", "subcategory", "confidence")
                                                if c in joined.columns]), "response")
    blank = F.col("_pkey").isNull()
    return parsed.select(
        *cols,
        F.when(blank, F.lit(UNCLEAR)).otherwise(F.col("category")).alias("category"),
        F.when(blank, F.lit("")).otherwise(F.col("subcategory")).alias("subcategory"),
        F.when(blank, F.lit(LOW)).otherwise(F.col("confidence")).alias("confidence"))


def enrich_statement(df: DataFrame, backend, category_backend=None, **kw) -> DataFrame:
    """Both stages: clean remarks, then categorise the cleaned text.

    The remark stage's replies are stored before the category stage builds
    its prompts, so the stages run as separate jobs (as the barrier between
    them requires) without repeating any call.
    """
    cleaned = materialize(clean_remarks(df, backend, **kw.get("remark", {})), "cleaned")
    return categorise(cleaned, category_backend or backend, **kw.get("category", {}))
