"""Session helpers: local sessions for tests/bench and the shared folder.

Library code never invents a machine-local folder on a cluster: shared state
(reply tables, checkpoints) lives under ``spark.checkpoint.dir``. Only local
sessions get a default when the setting is absent.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings the parsers rely on. Duplicate JSON keys must resolve
# last-wins (as Python's json module does) instead of failing the parse.
SEMANTIC_CONF = {
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, app: str = "ledgerlens",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and local runs (UI off, AQE on, UTC). Under
    spark-submit the cluster's settings stand; only the parsers' own are set."""
    b = SparkSession.builder.appName(app)
    # Under spark-submit (the JVM started this Python process) the cluster's
    # master stands; otherwise default to a local session for tests and runs.
    launched_by_submit = "PYSPARK_GATEWAY_PORT" in os.environ
    master = master or os.environ.get("LEDGERLENS_MASTER") or (None if launched_by_submit else "local[8]")
    if master:
        b = b.master(master)
    if not launched_by_submit:  # settings in code would override the cluster's
        b = (b
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.speculation", "false")
             .config("spark.driver.memory", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SEMANTIC_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_semantic_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_semantic_conf(spark: SparkSession) -> None:
    """Set the runtime flags the reply parsers need (idempotent)."""
    for k, v in SEMANTIC_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder; set one only for local sessions lacking it."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster run needs a shared folder")
        d = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path under the cluster's shared folder (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), *parts])


def fresh_shared_dir(spark: SparkSession, prefix: str) -> str:
    """A new, unique folder under the shared folder (for one job's output)."""
    return shared_dir(spark, f"{prefix}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared folder and read it back.

    Used where a derived table is queried several ways (the enriched
    statement, the cleaned remarks between enrichment stages): it cuts the
    lineage, so expensive derivations run once, failed tasks recompute from
    the stored table rather than from the source, and filters on derived
    columns hit a parquet scan instead of being rewritten into the
    derivation. Each call writes a new folder; nothing is overwritten.
    """
    return materialize_at(df, name)[0]


def materialize_at(df, name: str):
    """:func:`materialize`, also returning the folder written."""
    spark = df.sparkSession
    path = fresh_shared_dir(spark, f"ledgerlens/tables/{name}")
    df.write.parquet(path)
    intermediate(path)
    return spark.read.parquet(path), path


def intermediate(path: str) -> None:
    """Leave a folder to the :func:`scratch_scope` around the call, if there is one."""
    scopes = getattr(_SCOPES, "stack", None)
    if scopes:
        scopes[-1].append(path)


_SCOPES = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables materialized inside the block are intermediate: their folders
    are deleted when it ends. Wrap work whose result has been written (one
    streaming micro-batch) so a long-running job does not leave every
    batch's intermediate tables in the shared folder. Per thread."""
    stack = getattr(_SCOPES, "stack", None)
    if stack is None:
        stack = _SCOPES.stack = []
    paths: list[str] = []
    stack.append(paths)
    try:
        yield paths
    finally:
        stack.pop()
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            jp = jvm.org.apache.hadoop.fs.Path(p)
            jp.getFileSystem(conf).delete(jp, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerlens`` importable on executors (as ``--py-files`` would):
    zip the package once per application into the shared folder and add it
    with ``addPyFile``. Skipped when executors can already import it (e.g.
    it is installed)."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import io
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    path = shared_dir(spark, "ledgerlens", "pyfiles", f"{key}-{uuid.uuid4().hex[:8]}", "ledgerlens.zip")
    jvm = sc._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path)
    _SHIPPED.add(key)


# Rows of a costly step (regexes, lookups) that one task takes.
ROWS_PER_TASK = 250_000


def spread_rows(df, rows: int, rows_per_task: int = ROWS_PER_TASK):
    """Round-robin repartition of ``df``, of about ``rows`` rows, to tasks of ``rows_per_task`` where these are more than the cores:
    splits and joined partitions are sized by bytes, and millions of narrow rows in one task make a costly step long.
    A no-op for smaller inputs."""
    tasks = -(-rows // rows_per_task)
    return df.repartition(tasks) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def spread(df):
    """Round-robin repartition of a *file scan* to the cluster's core count
    when it has fewer splits than that (e.g. one small file with one row
    group), so the per-row CPU work after it uses every core. A no-op for
    large inputs, which arrive in many splits, so it adds no shuffle at
    scale. Call it on scans only: counting the partitions of a plan with
    exchanges would make adaptive execution run those stages."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
